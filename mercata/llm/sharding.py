"""Sharding by extendible hashing, in DataFrame operations only.

Rows are addressed by the leading bits of a hash of their key. A bucket is a
bit prefix; the directory starts with the empty prefix and only buckets over
the byte limit split on one more bit, until every bucket fits. Splits are not
run one job per bit: one aggregation gives the bytes of cells some bits deeper
than the expected number of shards, their sums over all shorter prefixes give
the whole split tree, and each cell's bucket is its shortest prefix that fits.
Only cells that still do not fit go through another round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.session import write_table

#: Bits of one md5-derived word (15 hex digits).
WORD_BITS = 60
#: Bits that one round looks ahead beyond the first.
ROUND_BITS = 12


def _bits(value: Column) -> Column:
    """The first 60 bits of md5(value) as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, 15), 16, 2), WORD_BITS, "0")


def extendible_shards(df: DataFrame, key: str, size: Column, limit_bytes: int) -> DataFrame:
    """One row per input row: ``key``, n_bytes, shard, local_depth, shard_bytes, shard_rows.

    ``shard`` is the bucket's bit prefix ('' while one bucket holds all).
    Address: 60 bits of md5(key as text), then 60 bits of md5(row number), so
    rows that share a key (a hot key, repeated rows) still split once the key's
    bits are used up. A bucket of one row is never split, even over the limit;
    every other bucket fits. A null key hashes as the empty string, a null size
    counts as 0 bytes; an empty input gives no rows.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = write_table(
        df.select(
            F.col(key).alias("key"),
            F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        ).select(
            "key", "n_bytes",
            F.concat(_bits(F.coalesce(F.col("key").cast("string"), F.lit(""))),
                     _bits(F.concat(F.lit("row "), F.col("row").cast("string")))).alias("bits"),
        ), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, look = 0, min(WORD_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    out = None
    while True:
        full = depth + look
        # Group by the cell: rows are pre-aggregated before the shuffle, hot cells included.
        cells = rows.groupBy(F.substring("bits", 1, full).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = write_table(cells, "shard-cells")
        tree = (cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(depth), F.lit(full))).alias("d"))
                .groupBy(F.expr("substring(cell, 1, d)").alias("shard"), F.col("d").alias("local_depth"))
                .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
                .filter((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_rows") == 1)
                        | (F.col("local_depth") >= 2 * WORD_BITS)))
        up = cells.select("cell", F.explode(F.sequence(F.lit(depth), F.lit(full))).alias("d")).select(
            "cell", F.expr("substring(cell, 1, d)").alias("shard"), F.col("d").alias("local_depth"))
        # No prefix above the shallowest bucket can match; the shortest ones would be every cell's key.
        up = up.filter(F.col("local_depth") >= tree.agg(F.min("local_depth")).scalar())
        leaf = (up.join(tree.hint("merge"), ["shard", "local_depth"])
                .groupBy("cell").agg(F.min_by(F.struct("shard", "local_depth", "shard_bytes", "shard_rows"),
                                              "local_depth").alias("leaf")))
        leaf = write_table(leaf, "shard-leaves")
        joined = rows.withColumn("cell", F.substring("bits", 1, full)).join(leaf.hint("merge"), "cell", "left")
        done = joined.filter(F.col("leaf").isNotNull()).select("key", "n_bytes", "leaf.*")
        out = done if out is None else out.unionByName(done)
        if cells.join(leaf, "cell", "left_anti").isEmpty():
            break
        rows = write_table(joined.filter(F.col("leaf").isNull()).select("key", "n_bytes", "bits"), "shard-rows")
        depth, look = full, min(ROUND_BITS, 2 * WORD_BITS - full)
    return out.withColumnRenamed("key", key)


def directory(assigned: DataFrame) -> DataFrame:
    """The directory behind an assignment: shard, local_depth, entries, shard_bytes, shard_rows.

    ``entries``: how many of the 2**global_depth directory slots point to the
    bucket. Buckets without rows are not listed.
    """
    buckets = assigned.groupBy("shard", "local_depth", "shard_bytes", "shard_rows").agg(F.lit(1).alias("_one"))
    deepest = buckets.agg(F.max("local_depth").alias("g"))
    return buckets.select(
        "shard", "local_depth", F.pow(F.lit(2.0), deepest.scalar() - F.col("local_depth")).alias("entries"),
        "shard_bytes", "shard_rows")
