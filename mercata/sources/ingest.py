"""CSV -> Parquet ingest with declared schemas (IN1, SC1-SC10).

Each file is read with its declared schema (no inference), ``"`` as quote and
escape, and a UTF-8 byte-order mark on the first header is dropped. Files are
split over tasks, those of tables whose quoted values may contain newlines
(``multi_line``) by quote parity (``sources.records``). Empty fields become
NULL, including for string columns. Rows that do not fit their schema are
flagged in the written table and counted from there, or refused with
``mode='FAILFAST'``. :func:`ingest_tables` overwrites plain folders;
``sources.catalog.load_tables`` replaces all tables at once.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mercata.sources.records import csv_records

Transform = Callable[[DataFrame], DataFrame]


CORRUPT = "_corrupt_record"
#: Stored beside a table's columns: whether the row did not fit its schema.
MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, mode: str = "PERMISSIVE",
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss", multi_line: bool = False, corrupt: bool = False) -> DataFrame:
    """Read CSV file(s) with a declared schema.

    ``mode='FAILFAST'`` rejects a malformed row; the default keeps it with
    NULLs in the fields that do not parse (ANSI casts would raise instead), and
    ``corrupt`` adds its text as ``_corrupt_record`` (NULL for good rows).
    ``multi_line``: quoted values may hold newlines; such files are split by
    quote parity and their records written once before they are parsed.
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())]) if corrupt else schema
    options = {"quote": '"', "escape": '"', "mode": mode, "columnNameOfCorruptRecord": CORRUPT,
               "timestampNTZFormat": timestamp_format, "timestampFormat": timestamp_format}
    if multi_line:
        parsed = F.from_csv("record", _ddl(full), {**options, "multiLine": "true"})
        df = csv_records(spark, path, header).select(parsed.alias("r")).select("r.*")
    else:
        df = spark.read.schema(full).options(**options).option("header", header).option("encoding", "UTF-8").csv(path)
    # An empty quoted string ("") is still '' for string columns: normalise to NULL.
    return df.select([F.when(F.col(f"`{f.name}`") == "", None).otherwise(F.col(f"`{f.name}`")).alias(f.name)
                      if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in full.fields])


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def normalize_text(columns: list[str]) -> Transform:
    """A transform that compares text the way a case-insensitive,
    trailing-blank-insensitive collation does: ``lower(rtrim(c))``. Spark
    compares strings byte-wise; apply this to join keys / labels at ingest
    when the source database matched case-insensitively."""
    def apply(df: DataFrame) -> DataFrame:
        return df.select([F.lower(F.rtrim(F.col(c))).alias(c) if c in columns else F.col(c) for c in df.columns])
    return apply


def read_source(spark: SparkSession, path: str, schema: StructType, header: bool = True, mode: str = "PERMISSIVE",
                multi_line: bool = False, transform: Transform | None = None) -> DataFrame:
    """A source table as it is stored: transformed columns and, unless malformed rows are refused, their flag."""
    df = read_csv(spark, path, schema, header=header, mode=mode, multi_line=multi_line, corrupt=mode == "PERMISSIVE")
    if mode == "PERMISSIVE":
        df = df.withColumn(MALFORMED, F.col(CORRUPT).isNotNull()).drop(CORRUPT)
    return df.transform(transform) if transform else df


def stored_counts(table: DataFrame, name: str) -> DataFrame:
    """(table_name, row_count, bad_rows) of a written table, exactly, in one pass over its flag column."""
    bad = F.count_if(MALFORMED) if MALFORMED in table.columns else F.lit(0).cast("long")
    return table.agg(F.count(F.lit(1)).alias("row_count"), bad.alias("bad_rows")).select(F.lit(name).alias("table_name"), "row_count", "bad_rows")


def ingest_tables(spark: SparkSession, src_dir: str, dst_dir: str, registry: Mapping[str, tuple[str, StructType]],
                  transforms: Mapping[str, Transform] | None = None, header: bool = True, mode: str = "PERMISSIVE",
                  multi_line: Collection[str] = ("order_reviews",)) -> DataFrame:
    """Load every ``name -> (csv file, schema)`` of ``registry`` into
    ``dst_dir/name`` as Parquet (overwrite), applying an optional per-table
    transform, and return exact row counts of the written tables with the
    number of malformed rows (0 under FAILFAST, which raises). The flag
    ``_malformed`` is stored with the rows.

    ``multi_line`` names the tables whose text may contain newlines.
    """
    transforms = transforms or {}
    counts = None
    for name, (filename, schema) in registry.items():
        out = os.path.join(dst_dir, name)
        read_source(spark, os.path.join(src_dir, filename), schema, header, mode, name in multi_line,
                    transforms.get(name)).write.mode("overwrite").parquet(out)
        c = stored_counts(spark.read.parquet(out), name)
        counts = c if counts is None else counts.unionByName(c)
    return counts
