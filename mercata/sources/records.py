"""Records of CSV files whose quoted values hold newlines, found in parallel.

A physical line starts a record when an even number of quotes stands before it
in its file (quotes inside values are doubled, RFC 4180). Spark's text reader
splits files by byte ranges; counting quotes per range gives, by a running
sum over the ranges, the parity at which each range begins. The task that reads
a range knows from there the parity at each line and puts the lines together as
they come, one Arrow batch and one open record at a time: lines are neither
shuffled, sorted nor written. A record that crosses ranges leaves a tail, which
is attached to the last record begun before it. Only one small row a range, and
the one or two records at a range's borders, ever meet across ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercata.session import write_table

BOM = "﻿"


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _joined(lines: Column) -> Column:
    """Pieces (place, text) in order, one line break between two of them."""
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["text"]), "\n")


def _pieces(borders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (range, odd, head, text) to pieces of records (range, nth, head, text): either those at the
    borders of ranges, which may go on in another range, or all others. nth: records begun in the range so far."""
    names = ["range", "nth", "head", "text"]

    def piece(at: tuple, nth: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([nth], pa.int64()), pa.array([at[1]], pa.bool_()),
                                           pa.array(["\n".join(lines)], pa.string())], names)

    def put_together(batches):
        now, nth, odd, lines = None, 0, 0, []
        for batch in batches:
            place = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)] if len(place) else []
            for a, b in zip(cuts, cuts[1:]):
                at, text = (int(place[a]), batch.column(2)[a].as_py()), batch.column(3).slice(a, b - a)
                if at != now:
                    if lines and borders:
                        yield piece(now, nth, lines)
                    now, nth, odd, lines = at, 0, int(batch.column(1)[a].as_py()), []
                quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype(np.int64)
                before = odd + np.cumsum(quotes) - quotes
                starts = np.flatnonzero(before % 2 == 0)
                odd = int(before[-1] + quotes[-1]) % 2
                if not len(starts):
                    lines.append("\n".join(text.to_pylist()))
                    continue
                lines += text.slice(0, starts[0]).to_pylist()
                if lines and borders == (nth == 0):
                    yield piece(at, nth, lines)
                if len(starts) > 1 and not borders:
                    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), text), "\n")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(whole), at[0])), pa.array(np.arange(nth + 1, nth + len(starts))),
                         pa.array(np.full(len(whole), at[1])), whole], names)
                nth += len(starts)
                lines = ["\n".join(text.slice(starts[-1]).to_pylist())]
        if lines and borders:
            yield piece(now, nth, lines)

    return put_together


def csv_records(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """One column ``record``: every CSV record of the file(s), without header lines, byte-order mark and empty lines.

    The quotes of each range are counted first (an action).
    Records end in LF or CRLF; in one that ends in CRLF, line breaks inside
    values become LF, as Spark's own reader has it. A quote inside a value that is not itself quoted
    shifts the borders after it: the records around it then do not fit the
    schema and are counted as malformed when they are parsed.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("_metadata.file_block_length").alias("bytes"), F.col("value").alias("text")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = (lines.groupBy("file", "block", "bytes").agg(F.sum(_quotes(F.col("text"))).alias("quotes"))
              .select("file", "block", "bytes", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"),
                      F.monotonically_increasing_id().alias("range")))
    ranges = write_table(ranges, "csv-ranges")
    # Later scans must be split as the counted one was: a range that was not counted is an error, not a loss.
    known = F.coalesce("range", F.raise_error(F.lit("the files or their splits changed while they were read")))
    placed = (lines.join(F.broadcast(ranges), ["file", "block", "bytes"], "left")
              .select(known.alias("range"), "odd", (F.col("block") == 0).alias("head"), "text"))
    kind = "range long, nth long, head boolean, text string"
    # Borders: a range's tail of an earlier record (nth = 0), and the last record begun in it.
    border = placed.mapInArrow(_pieces(True), kind).join(F.broadcast(ranges.select("range", "file", "block")), "range")
    order = Window.partitionBy("file").orderBy("block", "nth")
    border = border.withColumn("owner", F.count_if(F.col("nth") > 0).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = (border.groupBy("file", "owner").agg(F.collect_list(F.struct(F.struct("block", "nth").alias("place"), "text")).alias("parts"),
                                                     F.min(F.struct("block", "nth")).alias("at"))
                .select(F.col("at.nth").alias("nth"), (F.col("at.block") == 0).alias("head"), _joined(F.col("parts")).alias("text")))
    records = placed.mapInArrow(_pieces(False), kind).select("nth", "head", "text").unionByName(stitched)
    first = F.col("head") & (F.col("nth") == 1)
    text = F.when(first & F.startswith("text", F.lit(BOM)), F.substring("text", 2, 2_147_483_647)).otherwise(F.col("text"))
    crlf = F.endswith(text, F.lit("\r"))
    text = F.when(crlf, F.replace(text.substr(F.lit(1), F.length(text) - 1), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return (records.filter(~first) if header else records).select(text.alias("record")).filter(F.trim("record") != "")
