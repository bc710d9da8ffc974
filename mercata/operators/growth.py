"""Growth diagnosis: GMV trend and its decomposition by volume, price,
category and region.

Plan shape shared by all operators here: order items are first reduced to one
row per order (partial aggregation, so a hot order never reaches one task
whole), then joined 1:1 to the filtered orders. That replaces
``COUNT(DISTINCT order_id)`` over the items x orders fan-out with plain counts
and keeps every shuffle keyed on a unique key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.columns import ITEMS, ORDERS, conform, CUSTOMERS, PRODUCTS, TRANSLATION
from mercata.functions.expressions import (
    as_double, bucket_label, bucket_rank, count_buckets, money_ratio, month_of, ordered_mean, pct, pct_change,
)

Cols = Mapping[str, str] | None


def delivered_orders(orders: DataFrame, status: str = "delivered", cols: Cols = None,
                     extra: Sequence[str] = ()) -> DataFrame:
    """Orders in ``status`` (filter pushed to the scan) with the purchase month."""
    o = conform(orders, ("order_id", "customer_id", "order_status", "purchase_ts", *extra), cols)
    return (o.filter(F.col("order_status") == status)
            .select("order_id", "customer_id", "purchase_ts",
                    month_of("purchase_ts").alias("month"), *extra))


def order_gmv(orders: DataFrame, items: DataFrame, status: str = "delivered",
              cols: Cols = None, item_cols: Cols = None) -> DataFrame:
    """One row per ``status`` order that has items: order_id, customer_id,
    purchase_ts, month, gmv (sum of item prices, exact decimal)."""
    it = conform(items, ("order_id", "price"), item_cols)
    per_order = it.groupBy("order_id").agg(F.sum("price").alias("gmv"))
    return delivered_orders(orders, status, cols).join(per_order, "order_id")


# ---------------------------------------------------------------- G1 / G2 / G3 / G4

def monthly_gmv_trend(orders: DataFrame, items: DataFrame, status: str = "delivered",
                      cols: Cols = None, item_cols: Cols = None) -> DataFrame:
    """G1: month, order_count, gmv, aov (gmv / orders, half-up to cents)."""
    og = order_gmv(orders, items, status, cols, item_cols)
    return (og.groupBy("month")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("gmv").alias("gmv"))
            .select("month", "order_count", "gmv", money_ratio("gmv", "order_count").alias("aov")))


GROWTH_NAMES = {"gmv": "gmv_growth", "order_count": "order_growth", "aov": "aov_growth"}


def period_growth(trend: DataFrame, order_col: str = "month",
                  value_cols: Mapping[str, str] = GROWTH_NAMES) -> DataFrame:
    """Period-over-period growth in percent (``pct_change() * 100``).

    The window runs over the aggregated period table (one row per period), so
    its single ordered partition is bounded by the number of periods.
    """
    return trend.select("*", *[pct_change(c, [order_col]).alias(name)
                              for c, name in value_cols.items()])


def _inner_periods(df: DataFrame, order_col: str) -> DataFrame:
    """Drop the first and last period (first has no growth, last is partial)."""
    w = Window.orderBy(order_col)
    return (df.withColumn("_rn", F.row_number().over(w))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
            .filter((F.col("_rn") > 1) & (F.col("_rn") < F.col("_n")))
            .drop("_rn", "_n"))


def trend_summary(growth: DataFrame, order_col: str = "month", trim_first: bool = False) -> DataFrame:
    """Span and means over the inner periods.

    T17: by default growth is computed on the full series and then the first
    and last period are dropped (the script). ``trim_first=True`` is the
    notebook variant: drop the edges first, then compute growth, which loses
    one more period to the missing predecessor.
    """
    span = growth.agg(F.min(order_col).alias("first_month"), F.max(order_col).alias("last_month"),
                      F.count(F.lit(1)).alias("n_months"))
    inner = _inner_periods(growth, order_col)
    if trim_first:
        inner = period_growth(inner.drop(*GROWTH_NAMES.values()), order_col)
    means = inner.agg(
        F.count(F.lit(1)).alias("n_inner_months"),
        F.try_divide(as_double(F.sum("gmv")), as_double(F.count(F.lit(1)))).alias("mean_gmv"),
        F.try_divide(as_double(F.sum("order_count")), as_double(F.count(F.lit(1)))).alias("mean_orders"),
        F.try_divide(as_double(F.sum("aov")), as_double(F.count(F.lit(1)))).alias("mean_aov"),
        # Means over the (bounded) period table, summed in a fixed order.
        ordered_mean("gmv_growth").alias("mean_gmv_growth"),
        ordered_mean("order_growth").alias("mean_order_growth"),
        ordered_mean("aov_growth").alias("mean_aov_growth"))
    s = means.select(F.struct(*means.columns).alias("m")).scalar()
    return span.select("*", *[s.getField(c).alias(c) for c in means.columns])


def growth_driver(summary: DataFrame, ratio: float = 1.5) -> DataFrame:
    """G4: 'volume' when |order growth| > ratio * |aov growth|, else 'volume_and_price'."""
    return summary.select(
        "mean_order_growth", "mean_aov_growth",
        F.when(F.abs("mean_order_growth") > F.abs("mean_aov_growth") * F.lit(float(ratio)), "volume")
         .otherwise("volume_and_price").alias("driver"))


# ---------------------------------------------------------------- G5 / G6 / G7

def orders_per_customer(orders: DataFrame, status: str = "delivered", cols: Cols = None,
                        customer_key: str = "customer_id") -> DataFrame:
    o = conform(orders, ("order_id", customer_key, "order_status"), cols)
    return (o.filter(F.col("order_status") == status)
            .groupBy(customer_key).agg(F.count(F.lit(1)).alias("order_count")))


def purchase_frequency(orders: DataFrame, edges: Sequence[int] = (1, 2), status: str = "delivered",
                       cols: Cols = None, customer_key: str = "customer_id",
                       unit: tuple[str, str] = ("order", "orders")) -> DataFrame:
    """Users per purchase-count bucket (1 order, 2 orders, 3+ orders)."""
    buckets = count_buckets(edges, *unit)
    per_c = orders_per_customer(orders, status, cols, customer_key)
    n = F.col("order_count")
    return (per_c.groupBy(bucket_label(n, buckets).alias("frequency"), bucket_rank(n, buckets).alias("_r"))
            .agg(F.count(F.lit(1)).alias("user_count"))
            .drop("_r"))


def repeat_rate(orders: DataFrame, status: str = "delivered", cols: Cols = None,
                customer_key: str = "customer_id") -> DataFrame:
    """Total users, users with more than one order, repeat rate in percent."""
    per_c = orders_per_customer(orders, status, cols, customer_key)
    agg = per_c.agg(F.count(F.lit(1)).alias("total_users"),
                    F.count_if(F.col("order_count") > 1).alias("repeat_users"))
    return agg.select("*", pct("repeat_users", "total_users").alias("repeat_rate_pct"))


def monthly_customers(orders: DataFrame, items: DataFrame, status: str = "delivered",
                      first_only: bool = False, cols: Cols = None, item_cols: Cols = None) -> DataFrame:
    """Distinct active customers and GMV per month.

    ``first_only=True`` counts only customers whose first ``status`` month it
    is (true acquisition); the default counts all active customers, as the
    reference's "new customers" series does.
    """
    og = order_gmv(orders, items, status, cols, item_cols)
    cm = og.groupBy("month", "customer_id").agg(F.sum("gmv").alias("gmv"))
    if first_only:
        # Per-customer window over that customer's active months only.
        first = F.min("month").over(Window.partitionBy("customer_id"))
        cm = cm.withColumn("_first", first)
        return (cm.groupBy("month")
                .agg(F.count_if(F.col("month") == F.col("_first")).alias("customers"),
                     F.sum("gmv").alias("gmv")))
    return (cm.groupBy("month")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("gmv").alias("gmv")))


def customer_trend_edges(monthly: DataFrame, k: int = 6, value: str = "customers") -> DataFrame:
    """G7 (cont.): mean of ``value`` over the first k and the last k months."""
    asc = F.row_number().over(Window.orderBy("month"))
    desc = F.row_number().over(Window.orderBy(F.desc("month")))
    m = monthly.select("month", value, asc.alias("_a"), desc.alias("_d"))
    return m.agg(
        F.try_divide(as_double(F.sum(F.when(F.col("_a") <= k, F.col(value)))),
                     as_double(F.count_if(F.col("_a") <= k))).alias("first_k_mean"),
        F.try_divide(as_double(F.sum(F.when(F.col("_d") <= k, F.col(value)))),
                     as_double(F.count_if(F.col("_d") <= k))).alias("last_k_mean"))


# ---------------------------------------------------------------- G8 .. G12

def product_dimension(products: DataFrame, translation: DataFrame, product_cols: Cols = None,
                      translation_cols: Cols = None) -> DataFrame:
    """product_id, category: products joined with their translation once (inner
    joins: untranslated or uncategorised products drop out, as in the
    reference), so items never travel by category name."""
    p = conform(products, PRODUCTS, product_cols).filter(F.col("product_category_name").isNotNull())
    t = conform(translation, TRANSLATION, translation_cols)
    return p.join(t, "product_category_name").select("product_id", F.col("product_category_name_english").alias("category"))


def order_categories(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                     status: str = "delivered", cols: Cols = None, item_cols: Cols = None, product_cols: Cols = None,
                     translation_cols: Cols = None, keep: Sequence[str] = ()) -> DataFrame:
    """Per (order, category) of orders with ``status``: gmv, n_items and the order's ``keep`` columns.

    Items meet the orders first, so undelivered ones never reach the product join.
    """
    it = conform(items, ("order_id", "product_id", "price"), item_cols)
    o = delivered_orders(orders, status, cols).select("order_id", *keep)
    dim = product_dimension(products, translation, product_cols, translation_cols)
    return (it.join(o, "order_id").join(dim, "product_id").groupBy("order_id", *keep, "category")
            .agg(F.sum("price").alias("gmv"), F.count(F.lit(1)).alias("n_items")))


def category_coverage(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                      status: str = "delivered", cols: Cols = None, item_cols: Cols = None,
                      product_cols: Cols = None, translation_cols: Cols = None) -> DataFrame:
    """How much GMV the category analyses see. The inner joins on the
    translation drop items whose product has no category or an untranslated
    one; this reports total, categorised and untranslated GMV.

    Items are reduced per product before the product join, so a hot product
    is one row per partition by the time it is shuffled.
    """
    it = conform(items, ("order_id", "product_id", "price"), item_cols)
    o = delivered_orders(orders, status, cols).select("order_id")
    per_product = it.join(o, "order_id").groupBy("product_id").agg(F.sum("price").alias("gmv"))
    p = conform(products, PRODUCTS, product_cols)
    t = conform(translation, TRANSLATION, translation_cols).select(
        "product_category_name", F.lit(True).alias("_translated"))
    j = per_product.join(p, "product_id", "left").join(t, "product_category_name", "left")
    zero = F.lit(0).cast("decimal(38,2)")
    ok = F.col("_translated").isNotNull()
    g = j.agg(F.coalesce(F.sum("gmv"), zero).alias("total_gmv"),
              F.coalesce(F.sum(F.when(ok, F.col("gmv"))), zero).alias("categorised_gmv"),
              F.coalesce(F.sum(F.when(~ok, F.col("gmv"))), zero).alias("untranslated_gmv"))
    return g.select("*", pct("untranslated_gmv", "total_gmv").alias("untranslated_pct"))


def category_month_gmv(orders: DataFrame, items: DataFrame, products: DataFrame,
                       translation: DataFrame, status: str = "delivered", cols: Cols = None,
                       item_cols: Cols = None, product_cols: Cols = None,
                       translation_cols: Cols = None) -> DataFrame:
    """Month, category, gmv, order_count (distinct orders in the cell)."""
    per_oc = order_categories(orders, items, products, translation, status, cols, item_cols, product_cols,
                              translation_cols, keep=["month"])
    return (per_oc.groupBy("month", "category")
            .agg(F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("order_count")))


def category_totals(cat_month: DataFrame) -> DataFrame:
    """total_gmv, total_orders (sum of monthly distinct orders), months_active."""
    return (cat_month.groupBy("category")
            .agg(F.sum("gmv").alias("total_gmv"), F.sum("order_count").alias("total_orders"),
                 F.count_distinct("month").alias("months_active")))


def category_growth(cat_month: DataFrame) -> DataFrame:
    """GMV in the first and last month of the table per category.

    Categories present in neither month are absent; a missing side is 0.
    First / last month are scalar subqueries, so no join is needed.
    """
    first = cat_month.agg(F.min("month")).scalar()
    last = cat_month.agg(F.max("month")).scalar()
    g = (cat_month.groupBy("category")
         .agg(F.sum(F.when(F.col("month") == first, F.col("gmv"))).alias("first_gmv"),
              F.sum(F.when(F.col("month") == last, F.col("gmv"))).alias("last_gmv"))
         .filter(F.col("first_gmv").isNotNull() | F.col("last_gmv").isNotNull()))
    zero = F.lit(0).cast("decimal(38,2)")
    return (g.select("category", F.coalesce("first_gmv", zero).alias("first_gmv"),
                     F.coalesce("last_gmv", zero).alias("last_gmv"))
            .withColumn("gmv_change", F.col("last_gmv") - F.col("first_gmv")))


def top_gainers_decliners(cat_growth: DataFrame, k_up: int = 10, k_down: int = 5) -> DataFrame:
    """The k_up largest and k_down smallest GMV changes (ties by name)."""
    up = cat_growth.orderBy(F.desc("gmv_change"), "category").limit(k_up).withColumn("side", F.lit("gainer"))
    down = (cat_growth.orderBy("gmv_change", F.desc("category")).limit(k_down)
            .withColumn("side", F.lit("decliner")))
    return up.unionByName(down)


def topk_category_month_matrix(cat_month: DataFrame, k: int = 10) -> DataFrame:
    """Month x top-k category GMV, missing cells 0, in long form.

    Pivot on the (fixed) rank values 1..k, fill 0, unpivot back: no action to
    discover pivot values and no cross join to build the grid.
    """
    totals = cat_month.groupBy("category").agg(F.sum("gmv").alias("_t"))
    ranked = totals.select("category", F.row_number().over(
        Window.orderBy(F.desc("_t"), "category")).alias("category_rank")).filter(F.col("category_rank") <= k)
    cells = cat_month.join(F.broadcast(ranked), "category")  # ranked has at most k rows
    ranks = list(range(1, k + 1))
    wide = cells.groupBy("month").pivot("category_rank", ranks).agg(F.sum("gmv"))
    zero = F.lit(0).cast("decimal(38,2)")
    wide = wide.select("month", *[F.coalesce(F.col(str(r)), zero).alias(str(r)) for r in ranks])
    long = wide.unpivot("month", [str(r) for r in ranks], "category_rank", "gmv")
    long = long.withColumn("category_rank", F.col("category_rank").cast("int"))
    return (long.join(F.broadcast(ranked), "category_rank")
            .select("month", "category", "category_rank", "gmv"))


# ---------------------------------------------------------------- G13 / G14 / G15

def region_concentration(orders: DataFrame, items: DataFrame, customers: DataFrame,
                         status: str = "delivered", cols: Cols = None, item_cols: Cols = None,
                         customer_cols: Cols = None) -> DataFrame:
    """Per state orders, customers, gmv, aov, GMV share and cumulative share.

    Orders are reduced per customer before the customer join, so a customer
    with a huge number of orders is one row by the time it is shuffled.
    """
    og = order_gmv(orders, items, status, cols, item_cols)
    per_c = og.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("gmv").alias("gmv"))
    c = conform(customers, CUSTOMERS, customer_cols)
    st = (per_c.join(c, "customer_id")
          .groupBy(F.col("customer_state").alias("state"))
          .agg(F.sum("n_orders").alias("order_count"), F.count(F.lit(1)).alias("customer_count"),
               F.sum("gmv").alias("gmv")))
    # Windows over the per-state table (bounded by the number of states).
    total = F.sum("gmv").over(Window.partitionBy())
    running = F.sum("gmv").over(Window.orderBy(F.desc("gmv"), "state")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (st.select("state", "order_count", "customer_count", "gmv",
                      money_ratio("gmv", "order_count").alias("aov"),
                      pct("gmv", total).alias("gmv_share"),
                      pct(running, total).alias("gmv_cum_share")))


def concentration_summary(regions: DataFrame, ks: Sequence[int] = (1, 3, 5), reach_pct: float = 80.0,
                          concentrated_k: int = 3, concentrated_above: float = 60.0) -> DataFrame:
    """Top-k GMV shares, number of regions whose cumulative share is
    <= reach_pct, the leading region, and the concentration verdict."""
    r = regions.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("gmv"), "state")))
    aggs = [F.max(F.when(F.col("_rank") == 1, F.col("state"))).alias("top1_state")]
    # Cumulative share is non-decreasing, so its max over ranks <= k is the
    # top-k share (also when there are fewer than k regions).
    aggs += [F.max(F.when(F.col("_rank") <= k, F.col("gmv_cum_share"))).alias(f"top{k}_share") for k in ks]
    aggs += [F.count_if(F.col("gmv_cum_share") <= reach_pct).alias("n_to_reach"),
             F.max(F.when(F.col("_rank") <= concentrated_k, F.col("gmv_cum_share"))).alias("_ck")]
    out = r.agg(*aggs)
    return out.select("*", (F.col("_ck") > concentrated_above).alias("concentrated")).drop("_ck")


def growth_kpis(growth: DataFrame, cat_growth: DataFrame, order_col: str = "month") -> DataFrame:
    """Peak month, months with positive GMV growth among inner months,
    number of growing / declining categories."""
    inner = _inner_periods(growth, order_col)
    cats = cat_growth.agg(F.struct(F.count_if(F.col("gmv_change") > 0).alias("g"),
                                   F.count_if(F.col("gmv_change") < 0).alias("d")).alias("s")).scalar()
    peak = growth.agg(F.min_by(order_col, F.struct(-F.col("gmv"), F.col(order_col)))).scalar()
    return inner.agg(F.count_if(F.col("gmv_growth") > 0).alias("positive_months"),
                     F.count(F.lit(1)).alias("inner_months")).select(
        peak.alias("peak_month"), "positive_months", "inner_months",
        cats.getField("g").alias("growing_categories"), cats.getField("d").alias("declining_categories"))
