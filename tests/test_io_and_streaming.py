"""CSV ingest round trip (SC1-SC10) and the streaming A/B readout."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mercata.operators.experiment import arm_summary
from mercata.sources.fixtures import Fixtures
from mercata.sources.ingest import ingest_tables, read_csv
from mercata.sources.schemas import AB_SCHEMA, ECOMMERCE_SCHEMAS
from mercata.streaming import latest_arm_summary, start_arm_summary

from conftest import SF_SMALL


def test_csv_bom_multiline_quotes_and_nulls(spark):
    d = tempfile.mkdtemp(prefix="mercata-csv-")
    with open(os.path.join(d, "reviews.csv"), "w", encoding="utf-8") as f:
        f.write("﻿review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\n")
        f.write('r1,o1,5,,"line one\nline two",2018-01-01 10:00:00,2018-01-02 11:30:00\n')
        f.write('r2,o2,,"","say ""hi""",2018-01-03 00:00:00,\n')
    out = tempfile.mkdtemp(prefix="mercata-pq-")
    counts = ingest_tables(spark, d, out, {"order_reviews": ("reviews.csv", ECOMMERCE_SCHEMAS["order_reviews"])})
    assert [tuple(r) for r in counts.collect()] == [("order_reviews", 2, 0)]
    rows = {r.review_id: r for r in spark.read.parquet(os.path.join(out, "order_reviews")).collect()}
    assert set(rows) == {"r1", "r2"}                       # BOM stripped from the first header
    assert rows["r1"].review_comment_message == "line one\nline two"
    assert rows["r1"].review_comment_title is None         # empty field -> NULL
    assert rows["r2"].review_comment_title is None         # "" -> NULL
    assert rows["r2"].review_score is None
    assert rows["r2"].review_comment_message == 'say "hi"'
    assert rows["r2"].review_answer_timestamp is None
    assert str(rows["r1"].review_answer_timestamp) == "2018-01-02 11:30:00"


def test_headerless_ab_file(spark):
    d = tempfile.mkdtemp(prefix="mercata-ab-")
    path = os.path.join(d, "effect.csv")
    with open(path, "w") as f:
        f.write("1,100,0,x\n1,101,1,x\n2,102,1,\n")
    df = read_csv(spark, path, AB_SCHEMA, header=False)
    assert [tuple(r) for r in df.orderBy("user_id").collect()] == [(1, 100, 0, "x"), (1, 101, 1, "x"), (2, 102, 1, None)]


def test_streaming_readout_equals_batch(spark):
    events = Fixtures(spark, SF_SMALL).ab
    src = tempfile.mkdtemp(prefix="mercata-stream-src-")
    sink = os.path.join(tempfile.mkdtemp(prefix="mercata-stream-sink-"), "out")
    # Two arrivals of event files.
    events.filter(F.col("user_id") % 2 == 0).write.mode("append").parquet(src)
    events.filter(F.col("user_id") % 2 == 1).write.mode("append").parquet(src)
    checkpoint = tempfile.mkdtemp(prefix="mercata-stream-ckpt-")
    q = start_arm_summary(spark, src, events.schema, sink, checkpoint, name="test_arm_summary")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in latest_arm_summary(spark, sink).select("dmp_id", "n", "clicks", "click_rate").collect())
    want = sorted(tuple(r) for r in arm_summary(events).select("dmp_id", "n", "clicks", "click_rate").collect())
    assert got == want


def test_normalize_text_transform(spark):
    from mercata.sources.ingest import normalize_text
    df = spark.createDataFrame([("SP  ", "Keep"), ("sp", "x")], "state string, other string")
    out = df.transform(normalize_text(["state"])).collect()
    assert [r.state for r in out] == ["sp", "sp"] and out[0].other == "Keep"


def test_malformed_rows_are_counted_or_refused(spark):
    d = tempfile.mkdtemp(prefix="mercata-bad-")
    with open(os.path.join(d, "effect.csv"), "w") as f:
        f.write("1,100,0,x\n1,abc,1,x\n2,102,1,\n")
    registry = {"ab": ("effect.csv", AB_SCHEMA)}
    counts = ingest_tables(spark, d, tempfile.mkdtemp(prefix="mercata-pq-"), registry, header=False)
    assert [tuple(r) for r in counts.collect()] == [("ab", 3, 1)]
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_tables(spark, d, tempfile.mkdtemp(prefix="mercata-pq-"), registry, header=False, mode="FAILFAST")


def test_single_line_files_are_split(spark):
    d = tempfile.mkdtemp(prefix="mercata-big-")
    with open(os.path.join(d, "effect.csv"), "w") as f:
        f.writelines(f"1,{i},0,some text to fill the line\n" for i in range(60_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = read_csv(spark, os.path.join(d, "effect.csv"), AB_SCHEMA, header=False)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_intermediates_are_pruned_scans_and_need_a_shared_folder(spark):
    from mercata import session
    table = session.materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = table.filter("x > 4").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:bigint>" in plan and "PushedFilters: [IsNotNull(x), GreaterThan(x,4)]" in plan

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_written_tables_can_be_cleared(spark):
    from mercata import session
    session.clear_tables(spark)
    tables = [session.materialize(spark.range(n)) for n in (3, 4)]
    folders = {os.path.dirname(f).removeprefix("file:") for t in tables for f in t.inputFiles()}
    assert all(map(os.path.isdir, folders)) and len(folders) == 2
    assert session.clear_tables(spark) == 2 and not any(map(os.path.exists, folders))
    assert session.clear_tables(spark) == 0
