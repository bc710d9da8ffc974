"""Column-expression helpers shared by the operators (all JVM-side, codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def month_of(ts: str | Column) -> Column:
    """``DATE_FORMAT(ts, '%Y-%m')``."""
    return F.date_format(ts, "yyyy-MM")


def as_double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE; NULL when den is 0 (ANSI division would raise)."""
    return F.try_divide(as_double(num), as_double(den))


def pct(num: str | Column, den: str | Column) -> Column:
    """100 * num / den as DOUBLE; NULL when den is 0."""
    return F.try_divide(as_double(num) * F.lit(100.0), as_double(den))


def money_ratio(num: str | Column, den: str | Column) -> Column:
    """Decimal money / count rounded half-up to cents (``ROUND(SUM/COUNT, 2)``)."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.round(F.try_divide(num, den.cast("decimal(20,0)")), 2).cast(MONEY)


def ordered_sum(c: str | Column) -> Column:
    """Sum of a *small, bounded* group of doubles in ascending order.

    Floating-point addition is order-dependent and a shuffle does not fix the
    order rows arrive in; summing the sorted values makes the result
    bit-for-bit reproducible (re-runs, recomputation after a lost executor,
    other engines). Only for groups bounded by construction (periods, bins,
    table cells): the values are collected per group.
    """
    return F.aggregate(F.array_sort(F.collect_list(as_double(c))), F.lit(0.0), lambda acc, x: acc + x)


def ordered_mean(c: str | Column) -> Column:
    """Mean of a small bounded group via :func:`ordered_sum` (NULLs skipped)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_divide(ordered_sum(col), as_double(F.count(col)))


def pct_change(c: str, order: Sequence[str], partition: Sequence[str] = ()) -> Column:
    """pandas ``pct_change() * 100`` over an ordered (small) period table."""
    w = Window.partitionBy(*partition).orderBy(*order)
    prev = F.lag(as_double(c)).over(w)
    return (F.try_divide(as_double(c), prev) - F.lit(1.0)) * F.lit(100.0)


def count_buckets(edges: Sequence[int], singular: str, plural: str) -> list[tuple[str, int, int | None]]:
    """Integer buckets from inclusive upper edges: (1, 2, 5) -> 1, 2, 3-5, 6+.

    Returns ``(label, lo, hi)`` with ``hi=None`` for the open last bucket.
    """
    out, lo = [], 1
    for hi in edges:
        if lo == hi:
            out.append((f"{lo} {singular if lo == 1 else plural}", lo, hi))
        else:
            out.append((f"{lo}-{hi} {plural}", lo, hi))
        lo = hi + 1
    out.append((f"{lo}+ {plural}", lo, None))
    return out


def bucket_label(value: Column, buckets: Sequence[tuple[str, int, int | None]]) -> Column:
    """Searched CASE over ``count_buckets`` output (inclusive ranges)."""
    expr = None
    for label, lo, hi in buckets:
        cond = value >= lo if hi is None else value.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def bucket_rank(value: Column, buckets: Sequence[tuple[str, int, int | None]]) -> Column:
    expr = None
    for i, (_, lo, hi) in enumerate(buckets):
        cond = value >= lo if hi is None else value.between(lo, hi)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def right_closed_bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut(value, edges, right=True)``: (e0, e1], (e1, e2], ...; outside -> NULL."""
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (value > lo) & (value <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] of ``value`` (numpy/matplotlib ``hist``).

    The range comes from a scalar subquery, so the whole thing is one lazy
    plan: an aggregate for (min, max) and a partial-aggregated group-by on the
    bin index. Output: bin, bin_lo, bin_hi, count (empty bins included).
    """
    rng = df.agg(F.struct(F.min(as_double(value)).alias("lo"),
                          F.max(as_double(value)).alias("hi")).alias("r")).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((as_double(value) - lo) / width), F.lit(bins - 1)).cast("int"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # All bins, including empty ones: a fixed-size frame of `bins` rows.
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (lo + width * F.col("bin")).alias("bin_lo"),
                    (lo + width * (F.col("bin") + 1)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
