"""Global order statistics without a single-partition window.

``Window.orderBy(x)`` without ``partitionBy`` moves every row into one task.
Pareto shares, Gini, percent ranks and exact quantiles only need, for each
*distinct* value, how many rows (and how much weight) lie strictly below and
above it. :func:`value_ranks` computes exactly that:

1. collapse rows to distinct ``(group, value)`` with counts and weight sums
   (partial aggregation, so a hot value is one row before any shuffle);
2. range-partition these rows by (group, value) and write them once with their
   partition number: even, ordered buckets however many groups there are;
3. prefix-sum the per-bucket totals (one row per group and bucket);
4. prefix-sum inside each ``(group, bucket)`` and add the offset.

Every window is partitioned by ``(group, bucket)``. Results are exact; the
ranges only decide where buckets split. The write runs when the operator is
called; everything after it reads the small written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.session import write_table

GROUP = "_group"


def _bucketed(df: DataFrame, value: str, group: str | None, weight: str | None, count: str | None,
              buckets: int | None) -> DataFrame:
    """Distinct (group, value) rows with cnt, wsum and a value-range bucket, written once."""
    g = F.col(group) if group else F.lit(0)
    w = F.col(weight) if weight else F.lit(0)
    c = F.col(count) if count else F.lit(1)
    d = (df.filter(F.col(value).isNotNull())
         .groupBy(g.alias(GROUP), F.col(value).alias("value"))
         .agg(F.sum(c).cast("bigint").alias("cnt"), F.sum(w).alias("wsum")))
    ranged = d.repartitionByRange(buckets, GROUP, "value") if buckets else d.repartitionByRange(GROUP, "value")
    return write_table(ranged.withColumn("_bucket", F.spark_partition_id()), "ranks")


def _bucket_offsets(d: DataFrame) -> DataFrame:
    """Per (group, bucket): rows and weight in lower buckets, group totals.
    One row per group and bucket that meet; the window runs over that small table."""
    per_bucket = d.groupBy(GROUP, "_bucket").agg(F.sum("cnt").alias("_bc"), F.sum("wsum").alias("_bw"))
    before = Window.partitionBy(GROUP).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(GROUP)
    return per_bucket.select(
        F.col(GROUP).alias("_og"), F.col("_bucket").alias("_ob"), "_bc",
        F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_oc"),
        F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_ow"),
        F.sum("_bc").over(whole).alias("n_total"),
        F.sum("_bw").over(whole).alias("w_total"))


def _with_offsets(d: DataFrame, offsets: DataFrame) -> DataFrame:
    """Attach the bucket offsets (null-safe on the group; joined by size) and
    prefix-sum inside each (group, bucket) partition."""
    d = d.join(offsets, F.col(GROUP).eqNullSafe(F.col("_og")) & (F.col("_bucket") == F.col("_ob")))
    inside = Window.partitionBy(GROUP, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        GROUP, "value", "cnt", "wsum", "n_total", "w_total",
        (F.col("_oc") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("cnt_lt"),
        (F.col("_ow") + F.coalesce(F.sum("wsum").over(inside), F.lit(0))).alias("w_lt"))
    return d.select("*", (F.col("n_total") - F.col("cnt_lt") - F.col("cnt")).alias("cnt_gt"),
                    (F.col("w_total") - F.col("w_lt") - F.col("wsum")).alias("w_gt"))


def value_ranks(df: DataFrame, value: str, group: str | None = None, weight: str | None = None,
                count: str | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct values with their neighbourhood totals.

    Input: rows with ``value`` (NULLs ignored), optional ``group`` key,
    optional ``weight`` to sum, optional pre-aggregated row ``count``.
    Output columns: group (``_group`` if none given), value, cnt, wsum,
    cnt_lt, w_lt (strictly smaller values), cnt_gt, w_gt (strictly larger),
    n_total, w_total (per group).
    """
    d = _bucketed(df, value, group, weight, count, buckets)
    out = _with_offsets(d, _bucket_offsets(d))
    return out.withColumnRenamed(GROUP, group) if group else out


def _value_at(rank: Column) -> Column:
    """The distinct value covering 0-based ascending ``rank`` (else NULL)."""
    return F.when((F.col("cnt_lt") <= rank) & (rank < F.col("cnt_lt") + F.col("cnt")),
                  F.col("value").cast("double"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: str | None = None,
                    count: str | None = None, buckets: int | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / numpy 'linear',
    DuckDB ``quantile_cont``), one row per group, one column per prob.

    position = p * (n - 1); result = lo + (hi - lo) * (position - floor).
    Only the buckets that hold the ranks floor(position) / ceil(position) are
    sorted (selection); all other distinct values are only counted.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    d = _bucketed(df, value, group, None, count, buckets)
    offsets = _bucket_offsets(d)
    n1 = (F.col("n_total") - 1).cast("double")
    targets = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * n1
        targets += [F.floor(pos), F.ceil(pos)]
    # Buckets holding a target rank: at most 2 x len(probs) per group.
    need = (offsets.select("_og", "_ob", "_oc", "_bc", F.explode(F.array(*targets)).alias("_r"))
            .filter((F.col("_r") >= F.col("_oc")) & (F.col("_r") < F.col("_oc") + F.col("_bc")))
            .select("_og", "_ob").distinct())
    cand = d.join(need.withColumnsRenamed({"_og": "_ng", "_ob": "_nb"}),
                  F.col(GROUP).eqNullSafe(F.col("_ng")) & (F.col("_bucket") == F.col("_nb"))).drop("_ng", "_nb")
    r = _with_offsets(cand, offsets)
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * n1
        aggs += [F.max(_value_at(F.floor(pos))).alias(f"_lo{i}"),
                 F.max(_value_at(F.ceil(pos))).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr{i}")]
    a = r.groupBy(GROUP).agg(*aggs)
    outs = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).alias(names[i])
            for i in range(len(probs))]
    return a.select(F.col(GROUP).alias(group), *outs) if group else a.select(*outs)
