"""Skewed inputs against brute-force answers: a hot customer holding a third
of all orders, hot values, and global ranks computed without a global window."""

import datetime as dt
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.functions.ranking import exact_quantiles, value_ranks
from mercata.operators import customers as c


def _hot_orders(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cust = 0 if i % 3 == 0 else int(rng.integers(1, 400))  # customer 0 holds a third
        ts = dt.datetime(2020, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 500)))
        rows.append((i, cust, "delivered", ts))
    return spark.createDataFrame(rows, "order_id long, customer_id long, order_status string, purchase_ts timestamp_ntz")


def test_gap_distribution_matches_self_join_under_skew(spark):
    orders = _hot_orders(spark)
    got = sorted((r.days_between, r["count"]) for r in c.repurchase_gap_distribution(orders).collect())
    pdf = orders.toPandas()
    con = duckdb.connect()
    con.register("o", pdf)
    want = con.sql("""
        with r as (select customer_id, purchase_ts, row_number() over (partition by customer_id order by purchase_ts, order_id) rn from o)
        select datesub('day', a.purchase_ts, b.purchase_ts) d, count(*) from r a join r b
        on a.customer_id = b.customer_id and a.rn + 1 = b.rn group by 1 order by 1""").fetchall()
    assert got == [(int(a), int(b)) for a, b in want]


def test_value_ranks_hot_value_matches_naive(spark):
    rng = np.random.default_rng(3)
    vals = [5.0] * 1000 + [float(v) for v in rng.integers(0, 300, 2000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.value: (r.cnt_lt, r.cnt_gt) for r in value_ranks(df, "v", buckets=16).collect()}
    arr = np.array(vals)
    for v, (lt, gt) in got.items():
        assert lt == int((arr < v).sum()) and gt == int((arr > v).sum())


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_exact_quantiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(11)
    vals = np.concatenate([np.zeros(500), rng.lognormal(3, 1, 1500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    probs = [0.0, 0.2, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, buckets=buckets).collect()[0]
    assert list(got) == pytest.approx(list(np.quantile(vals, probs)), rel=1e-12)


def test_top_spender_penetration_matches_percent_rank(spark):
    rng = np.random.default_rng(5)
    n = 800
    orders = spark.createDataFrame(
        [(i, int(i % 400), "delivered", dt.datetime(2020, 1, 1)) for i in range(n)],
        "order_id long, customer_id long, order_status string, purchase_ts timestamp_ntz")
    # ties on purpose: prices from a small set
    items = spark.createDataFrame([(i, Decimal(int(rng.choice([10, 20, 20, 30, 50])))) for i in range(n)],
                                  "order_id long, price decimal(18,2)")
    cust = spark.createDataFrame([(i, f"S{i % 3}") for i in range(400)], "customer_id long, customer_state string")
    got = sorted(tuple(r) for r in c.top_spender_penetration(orders, items, cust, q=0.25, min_users=0)
                 .select("state", "hv_users", "total_users").collect())
    con = duckdb.connect()
    con.register("o", orders.toPandas())
    con.register("i", items.toPandas())
    con.register("c", cust.toPandas())
    want = con.sql("""
        with m as (select o.customer_id, sum(i.price) monetary from o join i using (order_id) group by 1),
        r as (select customer_id, percent_rank() over (order by monetary desc) pr from m)
        select c.customer_state, count(distinct case when pr <= 0.25 then o.customer_id end), count(distinct o.customer_id)
        from o join c using (customer_id) left join r using (customer_id) group by 1 order by 1""").fetchall()
    assert got == sorted(tuple(w) for w in want)


def test_gini_and_pareto_match_numpy(spark):
    rng = np.random.default_rng(9)
    money = np.round(rng.lognormal(4, 1.2, 3000), 2)
    money[:1000] = 100.0  # a hot value
    rfm = spark.createDataFrame([(i, Decimal(f"{m:.2f}")) for i, m in enumerate(money)],
                                "customer_id long, monetary decimal(38,2)")
    x = np.sort(money)
    n = len(x)
    g = 2 * np.sum(np.arange(1, n + 1) * x) / (n * x.sum()) - (n + 1) / n
    assert c.gini(rfm).collect()[0].gini == pytest.approx(g, rel=1e-9)
    desc = x[::-1]
    p = c.pareto_shares(rfm, top=(20,), bottom=50).collect()[0]
    assert p.top20_share == pytest.approx(100 * desc[: n * 20 // 100].sum() / x.sum(), rel=1e-9)
    assert p.bottom50_share == pytest.approx(100 * desc[n // 2:].sum() / x.sum(), rel=1e-9)


def test_rank_windows_are_partitioned(spark):
    """No window in the Pareto / Gini / penetration plans runs without a
    partition key (which would pull every customer into one task)."""
    rfm = spark.range(1000).select(F.col("id").alias("customer_id"),
                                   (F.col("id") % 97).cast("decimal(38,2)").alias("monetary"))
    for df in (c.pareto_shares(rfm), c.gini(rfm), c.lorenz_curve(rfm)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows, plan
        assert not any("], [], [" in w for w in windows), plan


def test_value_ranks_null_group_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    got = {(r.g, r.value): (r.cnt_lt, r.n_total) for r in value_ranks(df, "v", group="g", buckets=4).collect()}
    assert got == {(None, 1.0): (0, 2), (None, 2.0): (1, 2), ("a", 5.0): (0, 1)}
