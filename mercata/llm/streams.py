"""Sorted rows as a stream: numbering, groups that span Arrow batches, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.session import write_table

_BATCH_ROWS, _BATCH_BYTES = 4096, 8 << 20


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one tuple each."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def emit(found: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a few thousand rows or some megabytes of text each."""
    held, size = [], 0
    for r in found:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (str, bytes)))
        if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before (null equals null)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.and_(pc.fill_null(pc.not_equal(a, b), True), pc.invert(both)).to_numpy(zero_copy_only=False)


def _numbered(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0  # the group at the end of the batch before, and its rows so far
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in b.columns[:keys]:
                new[1:] |= _changes(c)
            first = tuple(c[0].as_py() for c in b.columns[:keys])
            start = np.where(new, np.arange(n), 0)
            np.maximum.accumulate(start, out=start)
            at = np.arange(n, dtype=np.int64) - start
            if first == last:
                at[: int(np.argmax(new)) if new.any() else n] += done
            last, done = tuple(c[n - 1].as_py() for c in b.columns[:keys]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "_in"])
    return run


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], label: str) -> DataFrame:
    """``df`` with ``at``: the row's 0-based place in its group, written once.

    Rows are range-partitioned by group, order and input place, so that a hot
    group, or a hot row repeated, is spread over tasks; each task numbers its
    sorted rows as a stream. Only groups that cross a partition border have an
    offset: fewer rows than there are partitions, hence the broadcast. Nulls
    come first; rows equal in group and order are numbered in input order.
    """
    names = [*group, *[c for c in df.columns if c not in group]]
    tied = df.select(*names, F.monotonically_increasing_id().alias("_tie"))
    ranged = (tied.repartitionByRange(*group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
              .select(*names, F.spark_partition_id().alias("_part")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    t = write_table(ranged.mapInArrow(_numbered(len(group)), f"{schema}, _in long"), label)
    per = t.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = (per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
                        F.sum("_c").over(before).alias("_before")).filter("_before is not null"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return t.join(F.broadcast(later), same, "left").select(*names, (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("at"))
