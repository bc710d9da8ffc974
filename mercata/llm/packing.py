"""Optimal length buckets and token-budget batches.

A global histogram of the lengths up to the batch budget (one aggregation, at
most one bin a length) goes to the driver; dynamic programming over it picks
the bucket boundaries with the least total padding. A longer row is a batch of
its own and needs none. Rows then get their bucket by a CASE expression and
batches form inside each bucket, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.session import write_table


def grid_length(n: int, step: int) -> int:
    """Smallest multiple of ``step`` that holds n tokens (at least one step)."""
    return max(1, -(-n // step)) * step


def _grid(n: Column, step: int) -> Column:
    """``grid_length`` as a column expression."""
    return F.greatest(F.lit(1), F.ceil(n / step).cast("long")) * step


def optimal_boundaries(histogram: Sequence[tuple[int, int, int]], buckets: int) -> list[int]:
    """Boundaries minimising padding: ``histogram`` has (grid length, rows, tokens), ascending.

    best[k][j] = min over i < j of best[k-1][i] + len_j * (rows in (i, j]) - tokens in (i, j].
    For fixed k the candidates i are lines in len_j with falling slopes, so the
    minimum comes off a convex hull in linear time. Exact integers throughout.
    """
    m = len(histogram)
    if m == 0:
        return []
    rows, tokens = [0], [0]
    for _, c, t in histogram:
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + t)
    best = [0] + [None] * m
    back: list[list[int]] = []
    for k in range(min(buckets, m)):
        now, came, hull, head = [None] * (m + 1), [0] * (m + 1), [], 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None and (k or i == 0):
                line = (-rows[i], best[i] + tokens[i], i)  # slope, intercept, where
                while len(hull) - head >= 2:
                    (s1, c1, _), (s2, c2, _) = hull[-2], hull[-1]
                    if (line[1] - c1) * (s1 - s2) <= (c2 - c1) * (s1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = histogram[j - 1][0]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                s, c, i = hull[head]
                now[j], came[j] = s * x + c + x * rows[j] - tokens[j], i
        best = now
        back.append(came)
    cuts, j = [], m
    for came in reversed(back):
        cuts.append(histogram[j - 1][0])
        j = came[j]
        if j == 0:
            break
    return cuts[::-1]


def pack(df: DataFrame, key: str, length: Column, buckets: int = 16, budget: int = 65_536, step: int = 1,
         chunk_rows: int = 100_000) -> DataFrame:
    """One row per input row: ``key``, n_tokens, bucket, padded_tokens, batch_id, position, batch_docs, padding.

    A batch holds rows of one bucket, each padded to the bucket's boundary, and
    at most ``budget`` tokens. Boundaries are multiples of ``step`` (1: any
    length) and minimise the padding of all rows up to the budget; a row longer
    than the budget is a batch alone, padded to its own length only, under the
    last bucket's number. Batches fill in chunks of about ``chunk_rows`` rows
    dealt by row number, so one length (or one repeated key) holding a third of
    all rows still spreads; each chunk leaves at most one batch unfilled. Null
    lengths count as 0; empty rows take the smallest bucket; an empty input
    gives no rows.
    """
    rows = write_table(df.select(
        F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("grid", _grid(F.col("n_tokens"), step)), "pack-rows")
    histogram = sorted((r[0], r[1], r[2]) for r in rows.filter(F.col("grid") <= budget).groupBy("grid")
                       .agg(F.count("*"), F.sum("n_tokens")).collect())
    cuts = optimal_boundaries(histogram, buckets) or [step]
    bucket, boundary, chunks = F.lit(len(cuts) - 1), F.col("grid"), F.lit(1)
    for i in reversed(range(len(cuts))):
        held = sum(c for g, c, _ in histogram if g <= cuts[i] and (i == 0 or g > cuts[i - 1]))
        here = F.col("grid") <= cuts[i]
        bucket = F.when(here, F.lit(i)).otherwise(bucket)
        boundary = F.when(here, F.lit(cuts[i]).cast("long")).otherwise(boundary)
        chunks = F.when(here, F.lit(max(1, -(-held // chunk_rows)))).otherwise(chunks)
    dealt = rows.select("key", "n_tokens", "row", bucket.cast("int").alias("bucket"), boundary.alias("padded_tokens"),
                        F.pmod(F.xxhash64("row"), chunks).cast("int").alias("chunk"), (F.col("grid") > cuts[-1]).alias("alone"))
    chunk = Window.partitionBy("bucket", "chunk")
    filled = F.row_number().over(chunk.orderBy("row")) - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_tokens")).cast("long"))
    together = (dealt.filter(~F.col("alone")).withColumn("_n", filled).withColumn("_all", F.count("*").over(chunk)).withColumn("_cap", capacity)
                .withColumn("_batch", F.floor(F.col("_n") / F.col("_cap")).cast("long"))
                .select(F.col("key").alias(key), "n_tokens", "bucket", "padded_tokens",
                        F.concat_ws("-", "bucket", "chunk", "_batch").alias("batch_id"),
                        (F.col("_n") % F.col("_cap")).cast("long").alias("position"),
                        F.least(F.col("_cap"), F.col("_all") - F.col("_batch") * F.col("_cap")).alias("batch_docs"),
                        (F.col("padded_tokens") - F.col("n_tokens")).alias("padding")))
    alone = dealt.filter("alone").select(
        F.col("key").alias(key), "n_tokens", "bucket", "padded_tokens", F.concat(F.lit("alone-"), "row").alias("batch_id"),
        F.lit(0).cast("long").alias("position"), F.lit(1).cast("long").alias("batch_docs"), (F.col("padded_tokens") - F.col("n_tokens")).alias("padding"))
    return together.unionByName(alone)
