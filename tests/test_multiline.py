"""Multi-line CSV split by quote parity equals Spark's one-task reader."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from mercata.sources.ingest import read_csv

SCHEMA = StructType([StructField("id", IntegerType()), StructField("a-b", StringType()), StructField("c", StringType())])


def _one_task(spark, path, header=True):
    df = (spark.read.schema(SCHEMA).option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    return df.select("id", *[F.when(F.col(f"`{c}`") == "", None).otherwise(F.col(f"`{c}`")).alias(c) for c in ("a-b", "c")])


def _write(name, text, mode="w"):
    path = os.path.join(tempfile.mkdtemp(prefix="mercata-multi-"), name)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _field(r, newline):
    kind = r.random()
    if kind < 0.3:
        return "plain text"
    if kind < 0.4:
        return ""
    if kind < 0.5:
        return '""'
    parts = [r.choice(["word", 'say ""hi""', newline, newline * 2, ",", "é🎉", "x" * r.randint(1, 60), '""', '""""']) for _ in range(r.randint(1, 12))]
    return '"' + "".join(parts) + '"'


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["200", "3k", "128m"])
def test_any_split_gives_the_same_rows(spark, newline, split):
    r = random.Random(int(split.rstrip("km")))
    text = f"﻿id,a-b,c{newline}" + "".join(f"{i},{_field(r, newline)},{_field(r, newline)}{newline}" for i in range(400 if split == "200" else 3000))
    path = _write("t.csv", text)
    want = sorted(map(tuple, _one_task(spark, path).collect()), key=repr)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted(map(tuple, read_csv(spark, path, SCHEMA, multi_line=True).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and got == want


def test_a_record_longer_than_ranges_and_files_without_an_end(spark):
    """One value runs over many ranges; the last line has no line break; several files, one of them empty."""
    folder = tempfile.mkdtemp(prefix="mercata-multi-")
    long_ = "\n".join(f"line {i}" for i in range(3000))
    for name, text in (("a.csv", f'id,a-b,c\n1,x,y\n2,"{long_}",z\n3,"{long_}","{long_}"'), ("b.csv", 'id,a-b,c\n4,,""\n\n5,"\n",q\n'), ("c.csv", "")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {r.id: tuple(r)[1:] for r in read_csv(spark, folder, SCHEMA, multi_line=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {1: ("x", "y"), 2: (long_, "z"), 3: (long_, long_), 4: (None, None), 5: ("\n", "q")}


def test_large_file_is_read_by_several_tasks(spark):
    r = random.Random(1)
    body = "\n".join("some review text, with commas" for _ in range(8))
    path = _write("big.csv", "id,a-b,c\n" + "".join(f'{i},"{body[: r.randint(0, 240)]}",""\n' for i in range(190_000)))
    assert os.path.getsize(path) > 22e6
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() >= 4
    df = read_csv(spark, path, SCHEMA, multi_line=True)
    key = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum("id"), F.sum(F.crc32(F.col("`a-b`").cast("binary"))), F.count("c")).first())
    assert key(df) == key(_one_task(spark, path))


def test_malformed_records_are_flagged_or_refused(spark):
    path = _write("bad.csv", 'id,a-b,c\n1,"x\ny",z\nnot a number,"p\nq",r\n3,too,many,fields\n')
    rows = {r.c: r for r in read_csv(spark, path, SCHEMA, multi_line=True, corrupt=True).collect()}
    assert rows["z"]._corrupt_record is None and rows["z"]["a-b"] == "x\ny"
    assert rows["r"].id is None and rows["r"]._corrupt_record.startswith("not a number")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, path, SCHEMA, multi_line=True, mode="FAILFAST").collect()


def test_lines_are_neither_shuffled_nor_written(spark, monkeypatch):
    """Only rows of ranges are stored, and only borders of ranges are sorted or exchanged, whatever a range holds."""
    from mercata.sources import records

    stored = []
    monkeypatch.setattr(records, "write_table", lambda df, label: stored.append(df.localCheckpoint()) or stored[-1])
    path = _write("t.csv", "id,a-b,c\n" + "".join(f'{i},"p\n\nq",""\n' for i in range(60_000)))
    df = records.csv_records(spark, path, header=True)
    assert df.count() == 60_000 and df.filter(F.col("record").rlike('^[0-9]+,"p\n\nq",""$')).count() == 60_000
    assert sum(t.count() for t in stored) == spark.read.text(path).rdd.getNumPartitions()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines, borders = plan.split("Union")[1].split("Aggregate")
    assert "Window" in borders and "Window" not in lines and "Repartition" not in plan and "rightHint=(strategy=broadcast)" in lines, plan
