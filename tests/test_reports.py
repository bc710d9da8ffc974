"""Reports over tables with the e-commerce DDL column names equal the
registered queries over the canonical fixture views (exercises the column
maps end to end)."""

import math
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from mercata.functions.columns import ECOMMERCE_DDL_COLUMNS
from mercata.plans import reports
from mercata.sources.fixtures import AS_OF, COHORT_CUTOFF, Fixtures

from conftest import SF_SMALL

Q = entry_mod.queries()


def _ddl_tables(spark):
    fx = Fixtures(spark, SF_SMALL)
    orders = fx.orders.withColumnsRenamed(ECOMMERCE_DDL_COLUMNS)
    return {"orders": orders, "order_items": fx.items, "products": fx.products,
            "product_category_translation": fx.translation, "customers": fx.customers,
            "order_payments": fx.payments, "order_reviews": fx.reviews}


def _rows(df):
    def norm(v):
        if isinstance(v, (float, Decimal)) and not (isinstance(v, float) and math.isnan(v)):
            return round(float(v), 9)
        return v
    return sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("report_key,query", [
    ("growth_01_trend", "period_growth"), ("growth_03_category_growth", "category_growth"),
    ("growth_04_regions", "region_concentration"), ("growth_kpis", "growth_kpis"),
])
def test_growth_report_matches_queries(spark, report_key, query):
    out = reports.growth_report(_ddl_tables(spark))
    assert _rows(out[report_key]) == _rows(Q[query](spark, SF_SMALL))


def test_customer_and_delivery_reports_match_queries(spark):
    t = _ddl_tables(spark)
    cu = reports.customer_report(t, as_of=AS_OF, cohort_cutoff=COHORT_CUTOFF, min_users=50)
    for key, query in [("user_02_gaps", "repurchase_gap_distribution"), ("user_03_segments", "segment_stats"),
                       ("user_04_pareto", "pareto_shares"), ("user_05_top_spender_penetration", "top_spender_penetration")]:
        assert _rows(cu[key]) == _rows(Q[query](spark, SF_SMALL)), key
    de = reports.delivery_report(t, min_region_orders=150)
    for key, query in [("ux_02_delay_vs_score", "delay_vs_score"), ("ux_03_delay_by_region", "delay_by_region"),
                       ("ux_05_dose_response", "delay_dose_response")]:
        assert _rows(de[key]) == _rows(Q[query](spark, SF_SMALL)), key
    assert "payment_label" in cu["user_05_payment_mix"].columns


def test_experiment_report_and_sink(spark):
    out = reports.experiment_report(Fixtures(spark, SF_SMALL).ab)
    assert _rows(out["ab_arms"]) == _rows(Q["arm_summary"](spark, SF_SMALL))
    d = tempfile.mkdtemp(prefix="mercata-report-")
    reports.write_tables(out, d)
    assert sorted(os.listdir(d)) == sorted(out)
    assert spark.read.parquet(os.path.join(d, "ab_decision")).count() == 1


def test_scorecard_report_matches_queries(spark):
    from mercata.sources.fixtures import (APPLICANT_FEATURES, APPLICANT_IMPUTE, APPLICANT_KEY,
                                          APPLICANT_RANGES)
    run = lambda rows: reports.scorecard_report(rows, list(APPLICANT_FEATURES), "target", list(APPLICANT_KEY),
                                                list(APPLICANT_RANGES), list(APPLICANT_IMPUTE))
    assert _rows(run(Fixtures(spark, SF_SMALL).applicants)["score_iv"]) == _rows(Q["iv_table"](spark, SF_SMALL))
    # The model entries are over the stand-in whose default depends on several features.
    out = run(Fixtures(spark, SF_SMALL).applicants_multi)
    assert _rows(out["score_iv"]) == _rows(Q["multi_iv_table"](spark, SF_SMALL))
    assert out["score_coefficients"].count() == 4
    auc = {r.split: r.auc for r in out["score_auc"].collect()}
    for r in Q["auc"](spark, SF_SMALL).collect():  # the query rounds scores
        assert auc[r.split] == pytest.approx(r.auc, abs=1e-3)
    assert out["score_points"].count() == Q["scorecard_points"](spark, SF_SMALL).count()
    assert out["score_roc"].filter("fpr = 0 and tpr = 0").count() == 2


def test_scoring_after_ingest_in_one_session(spark):
    """Ingest counts malformed rows on its way; scoring afterwards must not see a trace of that."""
    from mercata.sources.ingest import ingest_tables
    from mercata.sources.schemas import AB_SCHEMA
    d = tempfile.mkdtemp(prefix="mercata-csv-")
    with open(os.path.join(d, "effect.csv"), "w") as f:
        f.write("1,100,0,x\n1,abc,1,x\n")
    counts = ingest_tables(spark, d, tempfile.mkdtemp(prefix="mercata-pq-"), {"ab": ("effect.csv", AB_SCHEMA)}, header=False)
    assert [tuple(r) for r in counts.collect()] == [("ab", 2, 1)]
    observed = Observation()
    spark.range(3).observe(observed, F.count(F.lit(1)).alias("n")).collect()
    assert observed.get["n"] == 3
    assert Q["predict"](spark, SF_SMALL).count() > 0
    assert Q["overfit_gap"](spark, SF_SMALL).count() == 1
