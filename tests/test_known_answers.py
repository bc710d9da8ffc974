"""Hand-made frames with known answers (one per semantic trap)."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercata.functions.ranking import exact_quantiles, value_ranks
from mercata.operators import customers as c
from mercata.operators import delivery as d
from mercata.operators import experiment as x
from mercata.operators import growth as g
from mercata.operators import scorecard as s

T = dt.datetime


def orders_frame(spark, rows):
    schema = ("order_id long, customer_id long, order_status string, purchase_ts timestamp_ntz, "
              "approved_ts timestamp_ntz, carrier_ts timestamp_ntz, delivered_ts timestamp_ntz, "
              "estimated_ts timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def test_timestampdiff_complete_units(spark):
    # 23 h -> 0 days; -36 h -> -1 day. F3: calendar days across midnight -> 1.
    o = orders_frame(spark, [
        (1, 1, "delivered", T(2020, 1, 1, 23), T(2020, 1, 1, 23), T(2020, 1, 1, 23), T(2020, 1, 2, 22), T(2020, 2, 1)),
        (2, 1, "delivered", T(2020, 1, 3), T(2020, 1, 3), T(2020, 1, 3), T(2020, 1, 1, 12), T(2020, 2, 1)),
    ])
    out = {r.order_id: r for r in d.fulfilment_durations(o).collect()}
    assert out[1].total_days == 0 and out[2].total_days == -1
    assert o.select(F.datediff("delivered_ts", "purchase_ts")).collect()[0][0] == 1


def test_delay_rules_and_null_estimate(spark):
    # Late by timestamp on the same calendar day is on time by calendar day.
    # A NULL estimate falls through to on time.
    o = orders_frame(spark, [
        (1, 1, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 10, 18), T(2020, 1, 10, 12)),
        (2, 1, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 12), T(2020, 1, 10)),
        (3, 1, "delivered", T(2020, 1, 1), None, None, T(2020, 1, 12), None),
    ])
    reviews = spark.createDataFrame([(1, 5), (2, 1), (3, 4)], "order_id long, review_score int")
    ts = {r.delivery_status: r.order_count for r in d.delay_vs_score(o, reviews, by="timestamp").collect()}
    cal = {r.delivery_status: r.order_count for r in d.delay_vs_score(o, reviews, by="calendar").collect()}
    assert ts == {"Delayed": 2, "On Time": 1}
    assert cal == {"Delayed": 1, "On Time": 2}


def test_exact_quantiles_linear(spark):
    # {1,2,3,10} at 1/3, 1/2, 2/3 -> 2.0, 2.5, 3.0
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = exact_quantiles(df, "v", [1 / 3, 0.5, 2 / 3], buckets=2).collect()[0]
    assert [r.q0, r.q1, r.q2] == pytest.approx([2.0, 2.5, 3.0])


def test_percent_rank_descending(spark):
    # {1,2,2,10} percent_rank by value desc: 10 -> 0, 2 -> 1/3, 1 -> 1
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,)], "v double")
    r = {row.value: row.cnt_gt / (row.n_total - 1) for row in value_ranks(df, "v", buckets=3).collect()}
    assert r == pytest.approx({10.0: 0.0, 2.0: 1 / 3, 1.0: 1.0})


def test_period_growth_and_inner_mean(spark):
    # Growth null, 10, -10, 21.21; mean over the inner months = 0
    trend = spark.createDataFrame(
        [("2020-01", 1, Decimal("100.00"), Decimal("100.00")), ("2020-02", 1, Decimal("110.00"), Decimal("110.00")),
         ("2020-03", 1, Decimal("99.00"), Decimal("99.00")), ("2020-04", 1, Decimal("120.00"), Decimal("120.00"))],
        "month string, order_count long, gmv decimal(38,2), aov decimal(18,2)")
    gr = g.period_growth(trend).collect()
    assert gr[0].gmv_growth is None
    assert [r.gmv_growth for r in gr[1:]] == pytest.approx([10.0, -10.0, 21.2121212], abs=1e-6)
    assert g.trend_summary(g.period_growth(trend)).collect()[0].mean_gmv_growth == pytest.approx(0.0, abs=1e-9)


def test_gap_median_variants(spark):
    # Gaps 1 x 9, 5 x 1, 9 x 1 -> median of distinct 5, weighted median 1
    gaps = spark.createDataFrame([(1, 9), (5, 1), (9, 1)], "days_between long, count long")
    r = c.repurchase_gap_stats(gaps).collect()[0]
    assert r.median_distinct == 5 and r.median_weighted == 1


def test_gap_buckets_right_closed(spark):
    # 0 and 10000 are out of range; 7 in (0,7], 8 in (7,14], 9999 in (365,9999]
    gaps = spark.createDataFrame([(v, 1) for v in (0, 7, 8, 9999, 10000)], "days_between long, count long")
    out = {r.gap_bucket: r["count"] for r in c.gap_buckets(gaps).collect()}
    assert out == {"0-7d": 1, "8-14d": 1, ">365d": 1, "out_of_range": 2}


def test_f_score_all_three_when_frequency_constant(spark):
    # R8 / T18
    rfm = spark.createDataFrame([(i, i, 1, Decimal(i)) for i in range(1, 10)],
                                "customer_id long, recency int, frequency long, monetary decimal(38,2)")
    assert {r.F_score for r in c.rfm_scores(rfm).collect()} == {3}


@pytest.mark.parametrize("values,expected", [((1, 1, 1, 1), 0.0), ((0, 0, 0, 1), 0.75)])
def test_gini(spark, values, expected):
    # R13 / T3
    rfm = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate(values)], "customer_id long, monetary decimal(38,2)")
    assert c.gini(rfm).collect()[0].gini == pytest.approx(expected)


def test_pareto_and_lorenz_tie_invariant(spark):
    rfm = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate([5] * 10 + [1] * 10)],
                                "customer_id long, monetary decimal(38,2)")
    p = c.pareto_shares(rfm, top=(5, 10, 20), bottom=50).collect()[0]
    assert p.top5_share == pytest.approx(100 * 5 / 60)
    assert p.bottom50_share == pytest.approx(100 * 10 / 60)
    curve = sorted(c.lorenz_curve(rfm, points=1000).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in curve] == list(range(1, 21))
    assert curve[-1].cum_gmv_pct == pytest.approx(100.0)


def test_qcut_single_bin(spark):
    # S3: 95 zeros + 1,2,3,4,98 with q=5 -> edges {0, 98} -> one bin
    df = spark.createDataFrame([(0.0,)] * 95 + [(1.0,), (2.0,), (3.0,), (4.0,), (98.0,)], "f double")
    bins = s.quantile_bins(df, ["f"], q=5).collect()
    assert [(b.bin, b.lo, b.hi) for b in bins] == [(0, 0.0, 98.0)]


def _binned(spark, cells):
    rows = []
    for value, (good, bad) in zip((1.0, 3.0), cells):
        rows += [(value, 0)] * good + [(value, 1)] * bad
    df = spark.createDataFrame(rows, "f double, target int")
    bins = spark.createDataFrame([("f", i, lo, hi) for i, (lo, hi) in enumerate([(1.0, 2.0), (2.0, 3.0)][:len(cells)])],
                                 "feature string, bin int, lo double, hi double")
    return df, bins


def test_woe_iv_known(spark):
    # (good, bad) = (80, 10), (20, 10) -> WOE -0.4700, +0.9163, IV 0.4159
    df, bins = _binned(spark, [(80, 10), (20, 10)])
    woe = s.woe_table(df, bins, "target", ["f"]).collect()
    assert [round(r.woe, 4) for r in woe] == [-0.47, 0.9163]
    iv = s.iv_table(s.woe_table(df, bins, "target", ["f"])).collect()[0]
    assert iv.iv == pytest.approx(0.4159, abs=1e-4) and iv.selected


def test_woe_zero_cell_policies(spark):
    # S5 / T14
    df, bins = _binned(spark, [(80, 0), (20, 10)])
    inf = s.iv_table(s.woe_table(df, bins, "target", ["f"], policy="inf")).collect()[0]
    assert math.isinf(inf.iv) and inf.selected
    smooth = s.iv_table(s.woe_table(df, bins, "target", ["f"], policy="smooth")).collect()[0]
    assert math.isfinite(smooth.iv)
    dropped = s.woe_table(df, bins, "target", ["f"], policy="drop").collect()
    assert [r.bin for r in dropped] == [1]


def test_scorecard_points(spark):
    # WOEs -0.4700 / +0.9163 with coef 0.8 and PDO 50 -> +27 / -53
    woe = spark.createDataFrame([("f", 0, 0.0, 1.0, math.log(0.5 / 0.8)), ("f", 1, 1.0, 2.0, math.log(0.5 / 0.2))],
                                "feature string, bin int, lo double, hi double, woe double")
    coefs = spark.createDataFrame([("f_woe", 0.8)], "feature string, coef double")
    assert [r.points for r in s.scorecard_points(woe, coefs).collect()] == [27.0, -53.0]


def test_auc_ks_ties(spark):
    # (0.9,1), (0.9,0), (0.5,1), (0.1,0) -> AUC 0.625, KS 0.5
    sc = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, target int")
    assert s.auc(sc).collect()[0].auc == pytest.approx(0.625)
    assert s.ks(s.roc_curve(sc)).collect()[0].ks == pytest.approx(0.5)


def test_chi_square_yates(spark):
    # AB3: [[90, 10], [80, 20]] -> 3.9216 (p 0.0477); Yates 3.1765 (p 0.0747); dof 1
    table = spark.createDataFrame([(1, 90, 10), (2, 80, 20)], "dmp_id int, n_0 long, n_1 long")
    r = x.chi_square_test(table).collect()[0]
    assert r.chi2_uncorrected == pytest.approx(3.9216, abs=1e-4)
    assert r.chi2 == pytest.approx(3.1765, abs=1e-4)
    assert r.dof == 1
    assert r.p_value_uncorrected == pytest.approx(0.0477, abs=1e-4)
    assert r.p_value == pytest.approx(0.0747, abs=1e-4)


def test_chi_square_symmetric_in_arms(spark):
    a = spark.createDataFrame([(1, 90, 10), (2, 80, 20)], "dmp_id int, n_0 long, n_1 long")
    b = spark.createDataFrame([(1, 80, 20), (2, 90, 10)], "dmp_id int, n_0 long, n_1 long")
    assert x.chi_square(a).collect()[0].chi2 == pytest.approx(x.chi_square(b).collect()[0].chi2)


def _tail(x, dof):
    """The chi-square upper tail from its finite sums: exact for every whole dof."""
    h = x / 2
    if dof % 2 == 0:
        return math.fsum(math.exp(-h + j * math.log(h) - math.lgamma(j + 1)) for j in range(dof // 2))
    return math.erfc(math.sqrt(h)) + math.fsum(math.exp(-h + (j - 0.5) * math.log(h) - math.lgamma(j + 0.5)) for j in range(1, dof // 2 + 1))


def test_chi2_tail_general_dof(spark):
    from mercata.functions.stats import chi2_sf, log_gamma
    cases = [(x, d) for d in (1, 2, 3, 4, 5, 7, 10, 31, 100, 501, 1000) for x in
             (1e-9, 0.01, 0.5, 1.0, 2.9, 3.0, 3.841458820694124, 5.991464547107979, 11.07, d * 0.9, d + 1.99, d + 2.0, d + 2.01, d * 1.2 + 1, 60.0, 300.0)]
    df = spark.createDataFrame([(float(x), d) for x, d in cases], "x double, dof int").repartition(2)
    out = df.select("x", "dof", chi2_sf(F.col("x"), F.col("dof")).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        want = _tail(r.x, r.dof)
        assert r.p == pytest.approx(want, rel=1e-11 if want > 1e-200 else 1e-9, abs=1e-13), (r.x, r.dof)
    # Any dof, and what has no tail.
    odd = spark.createDataFrame([(3.0, 2.5), (0.0, 3.0), (-1.0, 3.0), (math.inf, 3.0), (None, 3.0), (math.nan, 3.0), (1.0, 0.0), (1.0, None)],
                                "x double, dof double").select("x", chi2_sf(F.col("x"), F.col("dof")).alias("p")).collect()
    assert _tail(3.0, 2) < odd[0].p < _tail(3.0, 3)
    assert [r.p for r in odd[1:]] == [1.0, 1.0, 0.0, None, None, None, None]
    args = [0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.5]
    got = spark.createDataFrame([(a,) for a in args], "a double").select("a", log_gamma(F.col("a")).alias("g")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.a), rel=1e-13, abs=2e-14)


def test_contingency_refuses_a_continuous_outcome(spark):
    many = spark.range(3000).select((F.col("id") % 2).alias("dmp_id"), F.col("id").alias("click"))
    with pytest.raises(ValueError, match="outcomes"):
        x.contingency(many, values=None)
    few = x.contingency(many.withColumn("click", F.col("click") % 3), values=None)
    assert few.columns == ["dmp_id", "n_0", "n_1", "n_2", "n_other"]


def test_diff_ci(spark):
    # AB4: n 100 / 100, clicks 10 / 20 -> diff 0.10, SE 0.05, CI [0.002, 0.198]
    ev = spark.createDataFrame([(1, int(i < 10)) for i in range(100)] + [(2, int(i < 20)) for i in range(100)],
                               "dmp_id int, click int")
    r = x.diff_ci(x.arm_summary(ev)).collect()[0]
    assert (r.diff, r.se) == pytest.approx((0.10, 0.05))
    assert (r.ci_lower, r.ci_upper) == pytest.approx((0.002, 0.198))


def test_high_value_flag_has_no_cap(spark):
    # T4: every High-Value customer counts in the group (the reference kept 5,000)
    n = 6000
    seg = spark.range(n).select(F.col("id").alias("customer_id"), F.lit("High-Value").alias("segment"))
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.col("id").alias("customer_id"),
                                   F.lit("delivered").alias("order_status"),
                                   F.lit(T(2020, 1, 1)).cast("timestamp_ntz").alias("purchase_ts"))
    pays = spark.range(n).select(F.col("id").alias("order_id"), F.lit(1).alias("payment_sequential"),
                                 F.lit("card").alias("payment_type"), F.lit(Decimal("1.00")).alias("payment_value"))
    mix = c.group_payment_mix(orders, pays, seg).collect()
    assert [(r.user_group, r.payment_count) for r in mix] == [("High-Value", n)]


def test_repeat_rate_by_person_key(spark):
    # Two customer_ids of the same person are one repeat buyer after re-keying
    o = orders_frame(spark, [
        (1, 10, "delivered", T(2020, 1, 1), None, None, None, None),
        (2, 11, "delivered", T(2020, 3, 1), None, None, None, None),
        (3, 12, "delivered", T(2020, 3, 1), None, None, None, None),
    ])
    cust = spark.createDataFrame([(10, "p1"), (11, "p1"), (12, "p2")], "customer_id long, customer_unique_id string")
    assert g.repeat_rate(o).collect()[0].repeat_users == 0
    by_person = c.with_customer_key(o, cust)
    r = g.repeat_rate(by_person).collect()[0]
    assert (r.total_users, r.repeat_users) == (2, 1)
    assert {x.cohort_month: x.repurchasers for x in c.cohort_repurchase(by_person).collect()} == {"2020-01": 1, "2020-03": 0}


def test_trend_summary_trim_first_variant(spark):
    # Growth 10, -10, 21.21 -> script mean over inner months (10, -10) = 0;
    # notebook (trim first, then growth) keeps only -10.
    trend = spark.createDataFrame(
        [("2020-01", 1, Decimal("100.00"), Decimal("100.00")), ("2020-02", 1, Decimal("110.00"), Decimal("110.00")),
         ("2020-03", 1, Decimal("99.00"), Decimal("99.00")), ("2020-04", 1, Decimal("120.00"), Decimal("120.00"))],
        "month string, order_count long, gmv decimal(38,2), aov decimal(18,2)")
    r = g.trend_summary(g.period_growth(trend), trim_first=True).collect()[0]
    assert r.mean_gmv_growth == pytest.approx(-10.0)


def test_clean_applicants_nan_is_missing(spark):
    # NaN fails range tests and is imputed like NULL
    df = spark.createDataFrame([(1, 0, float("nan"), 5.0), (2, 1, 1.0, float("nan")), (3, 0, 2.0, 7.0), (4, 1, 3.0, None)],
                               "id int, target int, util double, income double")
    out = {r.id: r for r in s.clean_applicants(df, [("util", ">", 0.0)], "target", ["income"]).collect()}
    assert set(out) == {2, 3, 4}
    assert out[2].income == 7.0 and out[4].income == 7.0


def test_contingency_keeps_every_outcome(spark):
    # Outcomes outside the columns are counted, a NULL outcome is not, and the test refuses.
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (1, 2), (2, 7), (1, None)], "dmp_id int, click int")
    rows = {r.dmp_id: (r.n_0, r.n_1, r.n_other) for r in x.contingency(df).collect()}
    assert rows == {1: (1, 1, 1), 2: (1, 1, 1)}
    with pytest.raises(Exception, match="outside the contingency"):
        x.chi_square(x.contingency(df)).collect()
    whole = x.contingency(df, values=None)
    assert [c for c in whole.columns if c.startswith("n_")] == ["n_0", "n_1", "n_2", "n_7", "n_other"]
    assert x.chi_square(whole).collect()[0].n == 6
    assert [r.dmp_id for r in x.contingency(df, arms=[2]).collect()] == [2]


def test_quiet_experiment_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(e, a, int(e == 1 and i < 3 * a)) for e in (1, 2) for a in (1, 2) for i in range(10)],
                               "exp int, dmp_id int, click int")
    rows = {r.exp: r for r in x.chi_square_test(x.contingency(df, experiment_id="exp"), experiment_id="exp").collect()}
    assert rows[1].chi2 is not None and 0 < rows[1].p_value < 1
    assert rows[2].chi2 is None and rows[2].p_value is None and rows[2].min_expected == 0


def test_one_class_group_and_zero_spend_give_null(spark):
    from mercata.operators import customers, scorecard
    scored = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 0.1), ("b", 1, 0.5), ("b", 1, 0.7)], "g string, target int, score double")
    got = {r.g: r.auc for r in scorecard.auc(scored, group="g").collect()}
    assert got == {"a": 1.0, "b": None}
    zero = spark.createDataFrame([(1, 0.0), (2, 0.0)], "customer_id int, monetary double")
    assert customers.gini(zero).collect()[0].gini is None


def test_orders_without_a_time_have_no_gap(spark):
    from mercata.operators import customers
    rows = [(i, 1, "delivered", None) for i in range(3)] + [(9, 1, "delivered", "2018-01-01"), (10, 1, "delivered", "2018-01-04")]
    orders = spark.createDataFrame(rows, "order_id int, customer_id int, order_status string, t string").selectExpr(
        "order_id", "customer_id", "order_status", "cast(t as timestamp_ntz) as purchase_ts")
    assert [tuple(r) for r in customers.repurchase_gap_distribution(orders).collect()] == [(3, 1)]


def test_exact_split_keeps_rows_without_a_target(spark):
    from mercata.operators import scorecard
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "k int, target int")
    out = scorecard.stratified_split(df, ["k"], "target", test=0.3, exact=True)
    got = {(r.target, r.split): r["count"] for r in out.groupBy("target", "split").count().collect()}
    assert got == {(None, "test"): 6, (None, "train"): 14, (0, "test"): 12, (0, "train"): 28, (1, "test"): 12, (1, "train"): 28}


def test_nan_information_value_is_not_selected(spark):
    from mercata.operators import scorecard
    woe = spark.createDataFrame([("f", 0.0, 0.0, float("nan")), ("g", 0.9, 0.1, -2.2), ("g", 0.1, 0.9, 2.2)],
                                "feature string, good_pct double, bad_pct double, woe double")
    assert {r.feature: r.selected for r in scorecard.iv_table(woe).collect()} == {"f": False, "g": True}
