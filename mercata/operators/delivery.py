"""Fulfilment timing and delivery delay -> review score attribution.

Reviews can be several per order, and the attributions average over the
orders x reviews (x items) fan-out. Instead of materialising the fan-out, the
reviews are reduced to one row per order (rows, scored rows, score sum, bad
and good counts) and every average is rebuilt as a weighted sum over those
per-order rows: identical numbers, but each join is keyed on a unique order
id and a hot order or customer is collapsed by partial aggregation before it
is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.columns import CUSTOMERS, ORDERS, REVIEWS, conform
from mercata.functions.expressions import as_double, equal_width_histogram, pct, ratio
from mercata.operators.growth import product_dimension

Cols = Mapping[str, str] | None

DELAYED, ON_TIME = "Delayed", "On Time"


def _is_delayed(by: str) -> Column:
    """Two delay rules. 'timestamp': delivered > estimated (a NULL estimate
    falls through to on time); 'calendar': DATEDIFF(delivered, estimated) > 0."""
    if by == "timestamp":
        return F.coalesce(F.col("delivered_ts") > F.col("estimated_ts"), F.lit(False))
    if by == "calendar":
        return F.coalesce(F.datediff("delivered_ts", "estimated_ts") > 0, F.lit(False))
    raise ValueError(f"unknown delay rule {by!r}")


# ---------------------------------------------------------------- X1 .. X3

def fulfilment_durations(orders: DataFrame, status: str = "delivered", cols: Cols = None) -> DataFrame:
    """Per order, complete hours / days between the fulfilment stages.

    ``timestamp_diff`` counts complete units truncated toward zero
    (``TIMESTAMPDIFF``): 23 h -> 0 days, -36 h -> -1 day.
    """
    o = conform(orders, ORDERS, cols)
    o = o.filter((F.col("order_status") == status) & F.col("delivered_ts").isNotNull()
                 & F.col("carrier_ts").isNotNull() & F.col("approved_ts").isNotNull())
    return o.select(
        "order_id",
        F.timestamp_diff("HOUR", "purchase_ts", "approved_ts").alias("approval_hours"),
        F.timestamp_diff("DAY", "approved_ts", "carrier_ts").alias("handover_days"),
        F.timestamp_diff("DAY", "carrier_ts", "delivered_ts").alias("shipping_days"),
        F.timestamp_diff("DAY", "purchase_ts", "delivered_ts").alias("total_days"),
        F.when(F.col("delivered_ts") > F.col("estimated_ts"), "Delayed").otherwise("OnTime")
         .alias("delivery_status"))


def fulfilment_summary(durations: DataFrame) -> DataFrame:
    """Order count, delay rate and stage means; mean and median total days.

    The median is an exact percentile over whole-day values, whose distinct
    count is bounded by the date range.
    """
    return durations.agg(
        F.count(F.lit(1)).alias("n_orders"),
        pct(F.count_if(F.col("delivery_status") == "Delayed"), F.count(F.lit(1))).alias("delay_rate_pct"),
        F.avg("approval_hours").alias("mean_approval_hours"),
        F.avg("handover_days").alias("mean_handover_days"),
        F.avg("shipping_days").alias("mean_shipping_days"),
        F.avg("total_days").alias("mean_total_days"),
        F.median("total_days").alias("median_total_days"))


STAGES = ("approval_hours", "handover_days", "shipping_days")


def stage_boxplot(durations: DataFrame, stages: Sequence[str] = STAGES, whisker: float = 1.5) -> DataFrame:
    """Box-plot statistics per stage (quartiles by linear interpolation,
    whiskers at the most extreme values within ``whisker`` * IQR, outliers)."""
    long = (durations.unpivot([], list(stages), "stage", "value")
            .filter(F.col("value").isNotNull()))
    stats = (long.groupBy("stage")
             .agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("_q"), F.count(F.lit(1)).alias("n"))
             .select("stage", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                     F.col("_q")[2].alias("q3"))
             .withColumn("iqr", F.col("q3") - F.col("q1")))
    lo = F.col("q1") - F.lit(whisker) * F.col("iqr")
    hi = F.col("q3") + F.lit(whisker) * F.col("iqr")
    # stats has one row per stage: a bounded broadcast.
    j = long.join(F.broadcast(stats.select("stage", lo.alias("_lo"), hi.alias("_hi"))), "stage")
    v = as_double("value")
    w = j.groupBy("stage").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("n_outliers"))
    return stats.join(w, "stage")


def total_days_histogram(durations: DataFrame, below: int = 60, bins: int = 50) -> DataFrame:
    """Equal-width histogram of total days for orders under ``below`` days."""
    return equal_width_histogram(durations.filter(F.col("total_days") < below), "total_days", bins)


# ---------------------------------------------------------------- X4 / X5 / X8

def reviews_per_order(reviews: DataFrame, cols: Cols = None) -> DataFrame:
    """One row per reviewed order: joined-row count, scored count, score sum,
    bad (<= 2) and good (>= 4) counts."""
    r = conform(reviews, REVIEWS, cols)
    s = F.col("review_score")
    return r.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(s).alias("n_scored"),
        F.sum(s).alias("score_sum"), F.count_if(s <= 2).alias("n_bad"), F.count_if(s >= 4).alias("n_good"))


def reviewed_deliveries(orders: DataFrame, reviews: DataFrame, status: str = "delivered",
                        cols: Cols = None, review_cols: Cols = None) -> DataFrame:
    """Delivered orders (delivery time known) joined 1:1 to their review rollup."""
    o = conform(orders, ORDERS, cols).filter(
        (F.col("order_status") == status) & F.col("delivered_ts").isNotNull())
    return o.join(reviews_per_order(reviews, review_cols), "order_id")


def delay_vs_score(orders: DataFrame, reviews: DataFrame, by: str = "timestamp", status: str = "delivered",
                   cols: Cols = None, review_cols: Cols = None) -> DataFrame:
    """Per delay status: orders, mean score, bad and good review rates."""
    rd = reviewed_deliveries(orders, reviews, status, cols, review_cols)
    g = (rd.groupBy(F.when(_is_delayed(by), DELAYED).otherwise(ON_TIME).alias("delivery_status"))
         .agg(F.count(F.lit(1)).alias("order_count"), F.sum("n_rows").alias("_rows"),
              F.sum("n_scored").alias("_scored"), F.sum("score_sum").alias("_score"),
              F.sum("n_bad").alias("_bad"), F.sum("n_good").alias("_good")))
    return g.select("delivery_status", "order_count", ratio("_score", "_scored").alias("avg_score"),
                    pct("_bad", "_rows").alias("bad_rate_pct"), pct("_good", "_rows").alias("good_rate_pct"))


def delay_score_gap(dvs: DataFrame) -> DataFrame:
    """Score and bad-rate gaps between on-time and delayed orders."""
    on = F.col("delivery_status") == ON_TIME
    late = F.col("delivery_status") == DELAYED
    g = dvs.agg(F.max(F.when(on, F.col("avg_score"))).alias("on_time_score"),
                F.max(F.when(late, F.col("avg_score"))).alias("delayed_score"),
                F.max(F.when(on, F.col("bad_rate_pct"))).alias("on_time_bad_rate_pct"),
                F.max(F.when(late, F.col("bad_rate_pct"))).alias("delayed_bad_rate_pct"))
    return g.select("*", (F.col("on_time_score") - F.col("delayed_score")).alias("score_gap"),
                    (F.col("delayed_bad_rate_pct") - F.col("on_time_bad_rate_pct")).alias("bad_rate_gap"))


SEVERITY_EDGES = (0, 3, 7, 14)


def severity_labels(edges: Sequence[int]) -> list[str]:
    """(0, 3, 7, 14) -> On Time / Early, 1-3, 4-7, 8-14 days late, >14 days late."""
    labels = ["On Time / Early"]
    labels += [f"{lo + 1}-{hi} days late" for lo, hi in zip(edges[:-1], edges[1:])]
    labels.append(f">{edges[-1]} days late")
    return labels


def delay_dose_response(orders: DataFrame, reviews: DataFrame, edges: Sequence[int] = SEVERITY_EDGES,
                        status: str = "delivered", cols: Cols = None, review_cols: Cols = None) -> DataFrame:
    """Review outcome by calendar days late (DATEDIFF(delivered, estimated))."""
    rd = reviewed_deliveries(orders, reviews, status, cols, review_cols)
    late = F.datediff("delivered_ts", "estimated_ts")
    labels = severity_labels(edges)
    label, rank = F.when(late <= edges[0], labels[0]), F.when(late <= edges[0], 0)
    for i, hi in enumerate(edges[1:], start=1):
        label, rank = label.when(late <= hi, labels[i]), rank.when(late <= hi, i)
    label, rank = label.otherwise(labels[-1]), rank.otherwise(len(edges))
    g = (rd.groupBy(label.alias("delay_severity"), rank.alias("severity_rank"))
         .agg(F.count(F.lit(1)).alias("order_count"), F.sum("n_rows").alias("_rows"),
              F.sum("n_scored").alias("_scored"), F.sum("score_sum").alias("_score"),
              F.sum("n_bad").alias("_bad")))
    return (g.select("delay_severity", "severity_rank", "order_count",
                     ratio("_score", "_scored").alias("avg_score"), pct("_bad", "_rows").alias("bad_rate_pct")))


# ---------------------------------------------------------------- X6 / X7

def _delay_facts(rd: DataFrame, weight: Column, by: str) -> list[Column]:
    """Weighted sums that rebuild the fan-out averages."""
    days = F.timestamp_diff("DAY", "purchase_ts", "delivered_ts")
    return [(weight * F.col("n_rows")).alias("_rows"),
            (weight * F.col("n_scored")).alias("_scored"),
            (weight * F.col("score_sum")).alias("_score"),
            (weight * F.col("n_rows") * F.when(_is_delayed(by), 1).otherwise(0)).alias("_delayed"),
            (weight * F.col("n_rows") * days).alias("_days")]


def _delay_metrics(g: DataFrame, key: str) -> DataFrame:
    return g.select(key, "order_count",
                    (ratio("_delayed", "_rows") * F.lit(100.0)).alias("delay_rate_pct"),
                    ratio("_score", "_scored").alias("avg_score"),
                    ratio("_days", "_rows").alias("avg_delivery_days"))


_SUMS = ("_rows", "_scored", "_score", "_delayed", "_days")


def delay_by_region(orders: DataFrame, reviews: DataFrame, customers: DataFrame, min_orders: int = 100,
                    by: str = "timestamp", status: str = "delivered", cols: Cols = None,
                    review_cols: Cols = None, customer_cols: Cols = None) -> DataFrame:
    """Per state delay rate, mean score and delivery days over reviewed
    deliveries (states with more than ``min_orders`` orders), flagged against
    the median state and with the max - min spread of delay rates."""
    rd = reviewed_deliveries(orders, reviews, status, cols, review_cols)
    facts = rd.select("customer_id", *_delay_facts(rd, F.lit(1), by))
    per_c = facts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"),
                                             *[F.sum(c).alias(c) for c in _SUMS])
    c = conform(customers, CUSTOMERS, customer_cols)
    g = (per_c.join(c, "customer_id").groupBy(F.col("customer_state").alias("state"))
         .agg(F.sum("order_count").alias("order_count"), *[F.sum(x).alias(x) for x in _SUMS]))
    res = _delay_metrics(g, "state").filter(F.col("order_count") > min_orders)
    # Windows over the per-state result (bounded by the number of states).
    all_rows = Window.partitionBy()
    return (res.select("*",
                       (F.col("delay_rate_pct") > F.median("delay_rate_pct").over(all_rows)).alias("above_median"),
                       (F.max("delay_rate_pct").over(all_rows) - F.min("delay_rate_pct").over(all_rows))
                       .alias("delay_rate_spread")))


def delay_by_category(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                      reviews: DataFrame, min_orders: int = 200, by: str = "timestamp",
                      status: str = "delivered", cols: Cols = None, item_cols: Cols = None,
                      product_cols: Cols = None, translation_cols: Cols = None,
                      review_cols: Cols = None) -> DataFrame:
    """Per category delay rate, mean score, delivery days over the
    items x reviews fan-out (T7), categories with more than ``min_orders``
    distinct orders."""
    rd = reviewed_deliveries(orders, reviews, status, cols, review_cols)
    facts = rd.select("order_id", *_delay_facts(rd, F.lit(1), by))
    # Everything keyed on the order meets first (no shuffle between tables bucketed by it), then the products.
    per_op = conform(items, ("order_id", "product_id"), item_cols).groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    dim = product_dimension(products, translation, product_cols, translation_cols)
    per_oc = (per_op.join(facts, "order_id").join(dim, "product_id").groupBy("category", "order_id")
              .agg(F.sum("n").alias("n_items"), *[F.max(c).alias(c) for c in _SUMS]))
    g = per_oc.groupBy("category").agg(F.count(F.lit(1)).alias("order_count"),
                                       *[F.sum(F.col("n_items") * F.col(c)).alias(c) for c in _SUMS])
    return (_delay_metrics(g, "category").filter(F.col("order_count") > min_orders))


def extremes(df: DataFrame, by: str, key: str, k_top: int, k_bottom: int = 0) -> DataFrame:
    """The ``k_top`` largest and ``k_bottom`` smallest rows by ``by`` (ties by ``key``), marked by ``side``."""
    out = df.orderBy(F.desc(by), key).limit(k_top).withColumn("side", F.lit("top"))
    if k_bottom:
        out = out.unionByName(df.orderBy(by, F.desc(key)).limit(k_bottom).withColumn("side", F.lit("bottom")))
    return out


# ---------------------------------------------------------------- X9 / X10

def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row count per table (one UNION ALL of counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_quality_checks(orders: DataFrame, reviews: DataFrame, status: str = "delivered",
                        cols: Cols = None, review_cols: Cols = None) -> DataFrame:
    """Status share, deliveries stamped before purchase, review-score null rate."""
    o = conform(orders, ORDERS, cols)
    r = conform(reviews, REVIEWS, review_cols)
    null_rate = r.agg(pct(F.count_if(F.col("review_score").isNull()), F.count(F.lit(1)))).scalar()
    return o.agg(
        F.count(F.lit(1)).alias("n_orders"),
        pct(F.count_if(F.col("order_status") == status), F.count(F.lit(1))).alias("status_share_pct"),
        F.count_if(F.col("delivered_ts") < F.col("purchase_ts")).alias("delivered_before_purchase"),
    ).select("*", null_rate.alias("review_score_null_pct"))
