"""Customer quality: purchase frequency, cohorts, repurchase gaps, RFM,
concentration (Pareto, Lorenz, Gini) and the high-value profile.

All per-customer tables are built by partial aggregation (orders -> one row
per order -> one row per customer). Global order statistics (tertiles,
Pareto cut points, percent ranks, Gini) come from ``functions.ranking`` over
distinct values, never from a window without a partition key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.columns import CUSTOMERS, PAYMENTS, conform
from mercata.functions.expressions import (
    as_double, bucket_label, bucket_rank, count_buckets, equal_width_histogram, ordered_mean, pct, ratio,
    right_closed_bucket,
)
from mercata.functions.ranking import value_ranks
from mercata.functions.selection import quantiles
from mercata.operators.growth import order_categories, delivered_orders, order_gmv

Cols = Mapping[str, str] | None

HIGH_VALUE = "High-Value"
# Segment names in their reporting order.
SEGMENTS = ("High-Value", "Potential", "Average", "At-Risk")


# ---------------------------------------------------------------- T1

def with_customer_key(orders: DataFrame, customers: DataFrame, key: str = "customer_unique_id",
                      cols: Cols = None, customer_cols: Cols = None) -> DataFrame:
    """Re-key orders by another customer identifier (e.g. the person-level
    ``customer_unique_id``; orders carry only the per-order ``customer_id``).

    The customers table is unique on customer_id, so this is a 1:1 join and
    every operator then counts repeat purchases per person.
    """
    o = orders.withColumnsRenamed({actual: canonical for canonical, actual in (cols or {}).items()})
    cu = conform(customers, ("customer_id", key), customer_cols)
    return (o.join(cu, "customer_id")
            .select(*[F.col(key).alias("customer_id") if c == "customer_id" else F.col(c) for c in o.columns]))


# ---------------------------------------------------------------- R1

def customer_value(orders: DataFrame, items: DataFrame, status: str = "delivered", cols: Cols = None,
                   item_cols: Cols = None) -> DataFrame:
    """customer_id, order_count, total_gmv, last_purchase_ts (orders with items)."""
    og = order_gmv(orders, items, status, cols, item_cols)
    return og.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"),
                                         F.sum("gmv").alias("total_gmv"),
                                         F.max("purchase_ts").alias("last_purchase_ts"))


def frequency_value_share(orders: DataFrame, items: DataFrame, edges: Sequence[int] = (1, 2, 5),
                          status: str = "delivered", cols: Cols = None, item_cols: Cols = None) -> DataFrame:
    """Users and GMV per purchase-count bucket, shares, and GMV-minus-user share."""
    buckets = count_buckets(edges, "time", "times")
    cv = customer_value(orders, items, status, cols, item_cols)
    n = F.col("order_count")
    g = (cv.groupBy(bucket_label(n, buckets).alias("frequency"), bucket_rank(n, buckets).alias("_r"))
         .agg(F.count(F.lit(1)).alias("user_count"), F.sum("total_gmv").alias("total_gmv")))
    every = Window.partitionBy()  # over the bucket table (a handful of rows)
    return (g.select("frequency", "user_count", pct("user_count", F.sum("user_count").over(every)).alias("user_pct"),
                     "total_gmv", pct("total_gmv", F.sum("total_gmv").over(every)).alias("gmv_pct"), "_r")
            .withColumn("pct_gap", F.col("gmv_pct") - F.col("user_pct"))
            .drop("_r"))


# ---------------------------------------------------------------- R2 / R3

def cohort_repurchase(orders: DataFrame, status: str = "delivered", cols: Cols = None,
                      customer_key: str = "customer_id") -> DataFrame:
    """R2: per first-purchase month, cohort size and the share of customers
    who bought again in a later month.

    One flag per customer (max month > first month) replaces the reference's
    CTE self-join and COUNT(DISTINCT CASE ...).
    """
    o = conform(orders, ("order_id", customer_key, "order_status", "purchase_ts"), cols)
    o = o.filter(F.col("order_status") == status)
    month = F.date_format("purchase_ts", "yyyy-MM")
    per_c = o.groupBy(customer_key).agg(F.min(month).alias("cohort_month"), F.max(month).alias("_last"))
    g = per_c.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"),
                                          F.count_if(F.col("_last") > F.col("cohort_month")).alias("repurchasers"))
    return (g.select("cohort_month", "cohort_size", "repurchasers",
                     pct("repurchasers", "cohort_size").alias("repurchase_rate")))


def cohort_summary(cohorts: DataFrame, cutoff: str) -> DataFrame:
    """Mean / max / min repurchase rate over cohorts up to ``cutoff``
    (inclusive, 'yyyy-MM'); ties resolve to the earliest month."""
    c = cohorts.filter(F.col("cohort_month") <= cutoff)
    rate, month = F.col("repurchase_rate"), F.col("cohort_month")
    return c.agg(F.count(F.lit(1)).alias("n_cohorts"), ordered_mean(rate).alias("mean_rate"),
                 F.max(rate).alias("max_rate"), F.min_by(month, F.struct(-rate, month)).alias("max_month"),
                 F.min(rate).alias("min_rate"), F.min_by(month, F.struct(rate, month)).alias("min_month"))


# ---------------------------------------------------------------- R4 / R5 / R6

def repurchase_gap_distribution(orders: DataFrame, status: str = "delivered", cols: Cols = None,
                                customer_key: str = "customer_id") -> DataFrame:
    """Complete days between consecutive orders of a customer, counted.

    Orders are first cut into (customer, calendar day) chunks. Consecutive
    orders inside one day are always 0 complete days apart, so a chunk of n
    orders contributes n - 1 zero gaps without any sort; the gap into a chunk
    is from the previous chunk's last order to this chunk's first order. The
    only window runs over a customer's active days, so even a customer with a
    third of all orders is split across days instead of sorted in one task.
    """
    o = conform(orders, ("order_id", customer_key, "order_status", "purchase_ts"), cols)
    # An order without a purchase time has no gap to anything.
    o = o.filter((F.col("order_status") == status) & F.col("purchase_ts").isNotNull())
    chunks = o.groupBy(customer_key, F.to_date("purchase_ts").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("purchase_ts").alias("_first"), F.max("purchase_ts").alias("_last"))
    prev = F.lag("_last").over(Window.partitionBy(customer_key).orderBy("_day"))
    cross = (chunks.select(F.timestamp_diff("DAY", prev, F.col("_first")).alias("days_between"))
             .filter(F.col("days_between").isNotNull())
             .select("days_between", F.lit(1).cast("bigint").alias("_c")))
    same_day = chunks.filter(F.col("_n") > 1).select(F.lit(0).cast("bigint").alias("days_between"),
                                                     (F.col("_n") - 1).cast("bigint").alias("_c"))
    return (cross.unionByName(same_day).groupBy("days_between").agg(F.sum("_c").alias("count")))


def repurchase_gap_stats(gaps: DataFrame, days: Sequence[int] = (30, 90)) -> DataFrame:
    """Median of the distinct gap values (as the reference reports it),
    the count-weighted median of all gaps, and the share of gaps within each
    of ``days``."""
    med_distinct = gaps.agg(F.median("days_between")).scalar()
    med_weighted = F.lit(quantiles(gaps, ["days_between"], [0.5], count="count")["days_between"][0]).cast("double")
    total = F.sum("count")
    shares = [pct(F.sum(F.when(F.col("days_between") <= d, F.col("count")).otherwise(0)), total)
              .alias(f"share_within_{d}d") for d in days]
    return gaps.agg(total.alias("n_gaps"), *shares).select(
        med_distinct.alias("median_distinct"), med_weighted.alias("median_weighted"), "*")


GAP_EDGES = (0, 7, 14, 30, 60, 90, 180, 365, 9999)


def gap_labels(edges: Sequence[int]) -> list[str]:
    """(0, 7, 14, ..., 365, 9999) -> 0-7d, 8-14d, ..., 181-365d, >365d."""
    labels = [f"{edges[0]}-{edges[1]}d"]
    labels += [f"{lo + 1}-{hi}d" for lo, hi in zip(edges[1:-2], edges[2:-1])]
    labels.append(f">{edges[-2]}d")
    return labels


def gap_buckets(gaps: DataFrame, edges: Sequence[int] = GAP_EDGES) -> DataFrame:
    """Gap counts in right-closed buckets (lo, hi]; gaps outside every
    bucket (0 days, > last edge) are reported as 'out_of_range' (T10)."""
    labels = gap_labels(edges)
    v = F.col("days_between")
    label = F.coalesce(right_closed_bucket(v, edges, labels), F.lit("out_of_range"))
    rank = F.lit(len(labels))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        rank = F.when((v > lo) & (v <= hi), i).otherwise(rank)
    return (gaps.groupBy(label.alias("gap_bucket"), rank.alias("bucket_rank"))
            .agg(F.sum("count").alias("count")).filter(F.col("count") > 0))


# ---------------------------------------------------------------- R7 .. R11

def rfm_base(orders: DataFrame, items: DataFrame, as_of: str, status: str = "delivered", cols: Cols = None,
             item_cols: Cols = None) -> DataFrame:
    """Recency (calendar days from the last purchase to ``as_of``),
    frequency (orders), monetary (item GMV) per customer."""
    cv = customer_value(orders, items, status, cols, item_cols)
    return cv.select("customer_id",
                     F.datediff(F.to_date(F.lit(as_of)), F.col("last_purchase_ts")).alias("recency"),
                     F.col("order_count").alias("frequency"),
                     F.col("total_gmv").alias("monetary"))


def rfm_thresholds(rfm: DataFrame) -> dict[str, Column]:
    """Exact 1/3 and 2/3 quantiles of R, F, M as literals (passes over ``rfm``, an action)."""
    found = quantiles(rfm, ["recency", "frequency", "monetary"], [1 / 3, 2 / 3])
    return {f"{m}_{p}": F.lit(v).cast("double") for m, c in (("r", "recency"), ("f", "frequency"), ("mo", "monetary"))
            for p, v in zip(("p33", "p67"), found[c])}


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Tertile scores 1..3 (recency: lower is better) and their total.

    The reference's comparisons are kept exactly (T18): with p33 = p67 every
    customer at or above it scores 3.
    """
    t = rfm_thresholds(rfm)
    r, f, m = as_double("recency"), as_double("frequency"), as_double("monetary")
    r_s = F.when(r <= t["r_p33"], 3).when(r <= t["r_p67"], 2).otherwise(1)
    f_s = F.when(f >= t["f_p67"], 3).when(f >= t["f_p33"], 2).otherwise(1)
    m_s = F.when(m >= t["mo_p67"], 3).when(m >= t["mo_p33"], 2).otherwise(1)
    return rfm.select("*", r_s.alias("R_score"), f_s.alias("F_score"), m_s.alias("M_score"),
                      (r_s + f_s + m_s).alias("RFM_total"))


def rfm_segments(scored: DataFrame) -> DataFrame:
    """Segment by quartiles of the RFM total (exact percentile over the
    handful of possible totals)."""
    q = scored.agg(F.struct(F.percentile("RFM_total", [0.75, 0.5, 0.25]).alias("q")).alias("s")).scalar()
    qs = q.getField("q")
    tot = F.col("RFM_total")
    seg = (F.when(tot >= qs[0], SEGMENTS[0]).when(tot >= qs[1], SEGMENTS[1])
           .when(tot >= qs[2], SEGMENTS[2]).otherwise(SEGMENTS[3]))
    return scored.select("*", seg.alias("segment"))


def _segment_rank():
    expr = F.lit(len(SEGMENTS))
    for i, s in reversed(list(enumerate(SEGMENTS))):
        expr = F.when(F.col("segment") == s, i).otherwise(expr)
    return expr


def segment_stats(segmented: DataFrame) -> DataFrame:
    """Per segment users, mean R / F / M, GMV, user and GMV shares."""
    g = segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("user_count"), F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        ratio(F.sum("monetary"), F.count(F.lit(1))).alias("avg_monetary"),
        F.sum("monetary").alias("total_gmv"))
    every = Window.partitionBy()  # at most four rows
    return (g.select("*", pct("user_count", F.sum("user_count").over(every)).alias("user_pct"),
                     pct("total_gmv", F.sum("total_gmv").over(every)).alias("gmv_pct"),
                     _segment_rank().alias("segment_rank")))


def f_score_diagnostics(scored: DataFrame) -> DataFrame:
    """Per F score users, mean and median frequency; ``f_degenerate``
    when the overall median frequency is <= 1 (F carries no information)."""
    overall = scored.agg(F.median("frequency")).scalar()
    return (scored.groupBy("F_score")
            .agg(F.count(F.lit(1)).alias("user_count"), F.avg("frequency").alias("mean_frequency"),
                 F.median("frequency").alias("median_frequency"))
            .select("*", (overall <= 1).alias("f_degenerate")))


# ---------------------------------------------------------------- R12 .. R14

def _spend_ranks(rfm: DataFrame, value: str = "monetary") -> DataFrame:
    return value_ranks(rfm, value, weight=value)


def pareto_shares(rfm: DataFrame, top: Sequence[int] = (5, 10, 20), bottom: int = 50,
                  value: str = "monetary") -> DataFrame:
    """GMV share of the top p % customers by spend and of the bottom
    ``bottom`` %. With customers ranked by spend descending, rank r counts as
    top p % when r / N * 100 <= p, i.e. r <= floor(p * N / 100); the sum over
    the first k ranks does not depend on how ties are ordered."""
    r = _spend_ranks(rfm, value)

    def top_sum(p: int):
        k = F.floor(F.col("n_total") * p / 100)
        take = F.least(F.greatest(k - F.col("cnt_gt"), F.lit(0)), F.col("cnt"))
        return F.sum(F.col("value") * take)

    aggs = [F.max("n_total").alias("n_customers"), F.max("w_total").alias("total_gmv")]
    aggs += [top_sum(p).alias(f"_t{p}") for p in top]
    aggs.append(top_sum(100 - bottom).alias("_b"))
    a = r.agg(*aggs)
    return a.select("n_customers", "total_gmv",
                    *[pct(f"_t{p}", "total_gmv").alias(f"top{p}_share") for p in top],
                    pct(F.col("total_gmv") - F.col("_b"), "total_gmv").alias(f"bottom{bottom}_share"))


def gini(rfm: DataFrame, value: str = "monetary", verdict: float = 0.6) -> DataFrame:
    """Exact Gini coefficient of spend (T3: the reference's trapezoid on a
    descending curve has the wrong sign; this is the standard coefficient).

    G = 2 * sum(i * x_(i)) / (n * sum(x)) - (n + 1) / n with x ascending; the
    ranks of a tied group starting after L smaller rows sum to
    c * L + c * (c + 1) / 2. With decimal spend the rank-weighted sum is exact
    (DECIMAL(38, 2)), so only the final ratio is rounded. ``concentrated``: above ``verdict``.
    """
    r = _spend_ranks(rfm, value)
    c, lt = F.col("cnt"), F.col("cnt_lt")
    rank_sum = c * lt + F.floor(c * (c + F.lit(1)) / F.lit(2)).cast("bigint")
    a = r.agg(F.sum(F.col("value") * rank_sum).alias("_s"), F.max("n_total").alias("n"),
              F.max("w_total").alias("_w"))
    n = as_double("n")
    # No spend at all: no concentration to speak of, NULL.
    share = F.try_divide(F.lit(2.0) * as_double("_s"), n * as_double("_w"))
    return a.select("n", (share - (n + F.lit(1.0)) / n).alias("gini")).withColumn("concentrated", F.col("gini") > verdict)


def lorenz_curve(rfm: DataFrame, points: int = 1000, value: str = "monetary") -> DataFrame:
    """Cumulative GMV share against customer share, customers ranked by
    spend descending, every ``max(1, N // points)``-th rank (the curve output
    is thinned; shares at the kept ranks are exact).

    Ranks are generated per distinct value from its rank range, so a value
    shared by many customers yields only the kept ranks inside its range.
    """
    r = _spend_ranks(rfm, value)
    step = F.greatest(F.floor(F.col("n_total") / points), F.lit(1))
    g = F.col("cnt_gt")
    m_lo = F.ceil(g / step)
    m_hi = F.floor((g + F.col("cnt") - 1) / step)
    ms = F.when(m_lo <= m_hi, F.sequence(m_lo, m_hi)).otherwise(F.array().cast("array<bigint>"))
    e = r.select("value", "cnt_gt", "w_gt", "n_total", "w_total", step.alias("_step"),
                 F.explode(ms).alias("_m"))
    rank = F.col("_m") * F.col("_step") + 1
    cum = F.col("w_gt") + (rank - F.col("cnt_gt")) * F.col("value")
    return (e.select(rank.alias("rank"),
                     (ratio(rank, "n_total") * F.lit(100.0)).alias("user_pct"),
                     pct(cum, "w_total").alias("cum_gmv_pct")))


def spend_summary(rfm: DataFrame, q: float = 0.99, value: str = "monetary") -> DataFrame:
    """Mean, exact median and exact q-quantile of spend, customers at or
    below the quantile."""
    median, cut = (F.lit(x).cast("double") for x in quantiles(rfm, [value], [0.5, q])[value])
    return rfm.agg(F.count(F.lit(1)).alias("n_customers"),
                   ratio(F.sum(value), F.count(F.lit(1))).alias("mean"),
                   F.count_if(as_double(value) <= cut).alias("n_at_or_below_q")).select(
        "n_customers", "mean", median.alias("median"), cut.alias("q_value"),
        "n_at_or_below_q")


def spend_histogram(rfm: DataFrame, q: float = 0.99, bins: int = 80, value: str = "monetary") -> DataFrame:
    """Equal-width histogram of spend truncated at the exact q-quantile."""
    cut = F.lit(quantiles(rfm, [value], [q])[value][0]).cast("double")
    kept = rfm.filter(as_double(value) <= cut)
    return equal_width_histogram(kept, value, bins)


# ---------------------------------------------------------------- R15 .. R18

def _segment_flags(segmented: DataFrame, segment: str) -> DataFrame:
    """Customers of ``segment`` (no cap on their number, T4)."""
    return segmented.filter(F.col("segment") == segment).select("customer_id", F.lit(True).alias("_in"))


def group_category_preference(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                              segmented: DataFrame, segment: str = HIGH_VALUE, status: str = "delivered",
                              cols: Cols = None, item_cols: Cols = None, product_cols: Cols = None,
                              translation_cols: Cols = None) -> DataFrame:
    """Category GMV share among ``segment`` customers vs all others and
    the difference in percentage points.

    GMV is reduced to (customer, category) before the segment join, so a
    customer with a huge number of orders is a few rows when shuffled.
    """
    per_oc = order_categories(orders, items, products, translation, status, cols, item_cols, product_cols,
                              translation_cols, keep=["customer_id"])
    per_cc = per_oc.groupBy("customer_id", "category").agg(F.sum("gmv").alias("gmv"))
    j = per_cc.join(_segment_flags(segmented, segment), "customer_id", "left")
    inside = F.col("_in").isNotNull()
    zero = F.lit(0).cast("decimal(38,2)")
    g = j.groupBy("category").agg(F.coalesce(F.sum(F.when(inside, F.col("gmv"))), zero).alias("group_gmv"),
                                  F.coalesce(F.sum(F.when(~inside, F.col("gmv"))), zero).alias("others_gmv"))
    every = Window.partitionBy()  # over the category table
    g = g.select("category", "group_gmv", "others_gmv",
                 pct("group_gmv", F.sum("group_gmv").over(every)).alias("group_share"),
                 pct("others_gmv", F.sum("others_gmv").over(every)).alias("others_share"))
    return (g.withColumn("share_diff", F.col("group_share") - F.col("others_share")))


def group_preference_extremes(pref: DataFrame, k: int = 8) -> DataFrame:
    """The k categories the group prefers most and least."""
    top = pref.orderBy(F.desc("share_diff"), "category").limit(k).withColumn("side", F.lit("preferred"))
    low = pref.orderBy("share_diff", F.desc("category")).limit(k).withColumn("side", F.lit("avoided"))
    return top.unionByName(low)


# Display labels of payment types (others keep their code).
PAYMENT_LABELS = {"credit_card": "Credit Card", "boleto": "Boleto", "voucher": "Voucher",
                  "debit_card": "Debit Card", "not_defined": "N/A"}


def payment_label(code: str, labels: Mapping[str, str] = PAYMENT_LABELS):
    """Dictionary lookup with the code itself as default (a literal map,
    evaluated in generated code; no join)."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(code)], F.col(code))


def group_payment_mix(orders: DataFrame, payments: DataFrame, segmented: DataFrame, segment: str = HIGH_VALUE,
                      status: str = "delivered", cols: Cols = None, payment_cols: Cols = None,
                      labels: Mapping[str, str] | None = None) -> DataFrame:
    """Payments per type for ``segment`` customers vs others: count,
    mean value, share of the group's payments; with ``labels`` an extra
    ``payment_label`` column (J11)."""
    p = conform(payments, PAYMENTS, payment_cols)
    o = delivered_orders(orders, status, cols).select("order_id", "customer_id")
    per_ct = (p.join(o, "order_id").groupBy("customer_id", "payment_type")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("payment_value").alias("v")))
    j = per_ct.join(_segment_flags(segmented, segment), "customer_id", "left")
    grp = F.when(F.col("_in").isNotNull(), F.lit(segment)).otherwise(F.lit("Others"))
    g = j.groupBy(grp.alias("user_group"), "payment_type").agg(F.sum("n").alias("payment_count"),
                                                              F.sum("v").alias("_v"))
    per_group = Window.partitionBy("user_group")  # over the (group, type) table
    out = g.select("user_group", "payment_type", "payment_count",
                   ratio("_v", "payment_count").alias("avg_payment_value"),
                   pct("payment_count", F.sum("payment_count").over(per_group)).alias("share_pct"))
    return out.withColumn("payment_label", payment_label("payment_type", labels)) if labels else out


def top_spender_penetration(orders: DataFrame, items: DataFrame, customers: DataFrame, q: float = 0.25,
                            min_users: int = 100, status: str = "delivered", cols: Cols = None,
                            item_cols: Cols = None, customer_cols: Cols = None) -> DataFrame:
    """Per state, customers among the top ``q`` by spend
    (``PERCENT_RANK() OVER (ORDER BY spend DESC) <= q``) over all customers
    with ``status`` orders; states with more than ``min_users`` customers.

    percent_rank = (customers spending strictly more) / (N - 1) is monotone in
    spend, so membership is ``spend >= threshold`` with the threshold a scalar
    from the distinct-value ranks: no global window, no join back.
    """
    cv = customer_value(orders, items, status, cols, item_cols).select("customer_id", "total_gmv")
    r = value_ranks(cv, "total_gmv")
    prank = ratio("cnt_gt", F.greatest(F.col("n_total") - 1, F.lit(1)))
    threshold = r.filter(prank <= q).agg(F.min("value")).scalar()
    buyers = (conform(orders, ("customer_id", "order_status"), cols)
              .filter(F.col("order_status") == status).select("customer_id").distinct())
    spend = buyers.join(cv, "customer_id", "left")
    c = conform(customers, CUSTOMERS, customer_cols)
    top = F.col("total_gmv").isNotNull() & (F.col("total_gmv") >= threshold)
    g = (spend.join(c, "customer_id").groupBy(F.col("customer_state").alias("state"))
         .agg(F.count_if(top).alias("hv_users"), F.count(F.lit(1)).alias("total_users")))
    return (g.filter(F.col("total_users") > min_users)
            .select("state", "hv_users", "total_users", pct("hv_users", "total_users").alias("hv_penetration")))
