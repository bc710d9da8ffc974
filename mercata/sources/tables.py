"""Parquet table access for a scale-factor directory."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``{sf_dir}/{name}.parquet`` (file or directory)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored_row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) of Parquet tables, from the files' footers.

    The tables are opened through Spark's newer Parquet reader, which answers a
    COUNT from the metadata (``PushedAggregation`` in the plan): no row is read
    whatever the tables' size.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")  # concerns that reader only
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in listed.split(",") if x != "parquet"))
    try:
        opened = {name: spark.read.parquet(path) for name, path in paths.items()}
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", listed)
    out = None
    for name, df in opened.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
