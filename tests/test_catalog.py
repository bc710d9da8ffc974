"""Tables replaced as a whole, bucketed by order, read through the catalogue; counts from footers."""

import math
import os
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from mercata.functions.columns import ECOMMERCE_DDL_COLUMNS
from mercata.operators import delivery, growth
from mercata.sources import catalog
from mercata.sources.fixtures import Fixtures
from mercata.sources.schemas import ECOMMERCE_SCHEMAS
from mercata.sources.tables import stored_row_counts

from conftest import SF_SMALL

NAMES = ("orders", "order_items", "order_reviews", "products", "product_category_translation")


@pytest.fixture(scope="module")
def source(spark):
    """The stand-in tables as the CSV files that a user has: every column of the DDL, missing ones empty."""
    fx = Fixtures(spark, SF_SMALL)
    tables = {"orders": fx.orders.withColumnsRenamed(ECOMMERCE_DDL_COLUMNS), "order_items": fx.items, "order_reviews": fx.reviews,
              "products": fx.products, "product_category_translation": fx.translation}
    folder, registry = tempfile.mkdtemp(prefix="mercata-src-"), {}
    for name, df in tables.items():
        schema = ECOMMERCE_SCHEMAS[name]
        cols = [F.col(f.name).cast("string").alias(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in schema.fields]
        df.select(*cols).toPandas().to_csv(os.path.join(folder, f"{name}.csv"), index=False)
        registry[name] = (f"{name}.csv", schema)
    return folder, registry


def test_replace_all_or_nothing(spark, source, tmp_path):
    folder, registry = source
    root = str(tmp_path / "tables")
    first = {r.table_name: r.row_count for r in catalog.load_tables(spark, folder, root, registry, buckets=4).collect()}
    assert first["orders"] == Fixtures(spark, SF_SMALL).orders.count() and len(first) == 5
    opened = catalog.read_tables(spark, root)
    before = {n: sorted(map(repr, df.collect())) for n, df in opened.items()}

    # The next load brings fewer orders and fails in its fifth table: readers still see the old set, all of it.
    other = tempfile.mkdtemp(prefix="mercata-src-")
    for name, (file, _) in registry.items():
        lines = open(os.path.join(folder, file), encoding="utf-8").read().splitlines(keepends=True)
        with open(os.path.join(other, file), "w", encoding="utf-8") as f:
            f.writelines(lines[:20])
    broken = {**registry, list(registry)[4]: ("missing.csv", registry[list(registry)[4]][1])}
    with pytest.raises(Exception, match="missing.csv"):
        catalog.load_tables(spark, other, root, broken, buckets=4)
    after = catalog.read_tables(spark, root)
    assert {n: sorted(map(repr, df.collect())) for n, df in after.items()} == before
    assert {r.version for r in catalog.current(spark, root).collect()} == {1}

    # A load that ends switches all of them; readers that opened the old ones keep them.
    catalog.load_tables(spark, other, root, registry, buckets=4)
    now = catalog.read_tables(spark, root)
    assert {n: df.count() for n, df in now.items()} == {n: 19 for n in NAMES}
    assert sorted(map(repr, opened["orders"].collect())) == before["orders"]
    assert {r.version for r in catalog.current(spark, root).collect()} == {2}
    assert len(catalog.drop_versions(spark, root, keep=1)) == 1
    assert catalog.read_tables(spark, root, ["orders"])["orders"].count() == 19


def _rows(df):
    norm = lambda v: round(float(v), 9) if isinstance(v, (float, Decimal)) and not math.isnan(v) else v
    return sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_bucketed_tables_join_without_shuffling_orders(spark, source, tmp_path):
    folder, registry = source
    root = str(tmp_path / "tables")
    catalog.load_tables(spark, folder, root, registry, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = catalog.read_tables(spark, root)
        by_category = delivery.delay_by_category(t["orders"], t["order_items"], t["products"], t["product_category_translation"], t["order_reviews"],
                                                 min_orders=1, cols=ECOMMERCE_DDL_COLUMNS)
        trend = growth.monthly_gmv_trend(t["orders"], t["order_items"], cols=ECOMMERCE_DDL_COLUMNS)
        for df in (by_category, trend):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" in plan and not re.search(r"hashpartitioning\(order_id", plan), plan
            assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, plan
        fx = Fixtures(spark, SF_SMALL)
        assert _rows(by_category) == _rows(delivery.delay_by_category(fx.orders, fx.items, fx.products, fx.translation, fx.reviews, min_orders=1))
        assert _rows(trend) == _rows(entry_mod.queries()["monthly_gmv_trend"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_grow_with_the_largest_source(spark, source, tmp_path, monkeypatch):
    """A sorting task gets a bounded share: twice the buckets for twice the source, the same number for all tables."""
    folder, registry = source
    some = {n: registry[n] for n in ("orders", "order_items")}
    largest = max(os.path.getsize(os.path.join(folder, f)) for f, _ in some.values())
    for share, want in ((1, 4), (4, 4), (5, 8), (30, 32)):
        monkeypatch.setattr(catalog, "BUCKET_BYTES", largest // share + 1)
        root = str(tmp_path / f"tables{share}")
        catalog.load_tables(spark, folder, root, some, buckets=4)
        assert {r.buckets for r in catalog.current(spark, root).collect()} == {want}
        fx, t = Fixtures(spark, SF_SMALL), catalog.read_tables(spark, root)
        assert t["order_items"].count() == fx.items.count() and t["orders"].count() == fx.orders.count()


def test_counts_come_from_footers(spark):
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    df = stored_row_counts(spark, {t: f"{SF_SMALL}/{t}.parquet" for t in ("orders", "lineitem")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2, plan
    assert {r.table_name: r.row_count for r in df.collect()} == {
        t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet").count() for t in ("orders", "lineitem")}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == listed
