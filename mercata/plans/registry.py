"""Named analytics over the fixture views: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry composes the library operators exactly as a user would on their
own tables; parameters are the fixture parameters from ``sources.fixtures``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.operators import customers as c
from mercata.operators import delivery as d
from mercata.operators import experiment as x
from mercata.operators import growth as g
from mercata.operators import scorecard as s
from mercata.functions.columns import ECOMMERCE_DDL_COLUMNS
from mercata.session import ensure_checkpoint_dir, materialize
from mercata.sources.catalog import load_tables, read_tables
from mercata.sources.fixtures import (
    APPLICANT_FEATURES, APPLICANT_IMPUTE, APPLICANT_KEY, APPLICANT_RANGES, AS_OF, COHORT_CUTOFF, Fixtures,
)
from mercata.sources.ingest import normalize_text, read_csv
from mercata.sources.schemas import AB_SCHEMA, APPLICANT_SCHEMA, ECOMMERCE_SCHEMAS
from mercata.sources.tables import TEST_TABLES, stored_row_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return register


# ------------------------------------------------------------------ growth

def _trend(fx: Fixtures) -> DataFrame:
    # Small aggregated tables read by several steps / scalar subqueries are
    # written once (materialize) instead of being recomputed by each reader.
    return materialize(g.monthly_gmv_trend(fx.orders, fx.items))


def _growth(fx: Fixtures) -> DataFrame:
    return g.period_growth(_trend(fx))


def _cat_month(fx: Fixtures) -> DataFrame:
    return materialize(g.category_month_gmv(fx.orders, fx.items, fx.products, fx.translation))


def _regions(fx: Fixtures) -> DataFrame:
    return materialize(g.region_concentration(fx.orders, fx.items, fx.customers))


@query("monthly_gmv_trend")
def q_monthly_gmv_trend(fx):
    return g.monthly_gmv_trend(fx.orders, fx.items)


@query("period_growth")
def q_period_growth(fx):
    return _growth(fx)


@query("trend_summary")
def q_trend_summary(fx):
    return g.trend_summary(_growth(fx))


@query("growth_driver")
def q_growth_driver(fx):
    return g.growth_driver(g.trend_summary(_growth(fx)))


@query("purchase_frequency")
def q_purchase_frequency(fx):
    return g.purchase_frequency(fx.orders)


@query("repeat_rate")
def q_repeat_rate(fx):
    return g.repeat_rate(fx.orders)


@query("monthly_customers")
def q_monthly_customers(fx):
    return g.monthly_customers(fx.orders, fx.items)


@query("monthly_new_customers")
def q_monthly_new_customers(fx):
    return g.monthly_customers(fx.orders, fx.items, first_only=True)


@query("monthly_customers_edges")
def q_monthly_customers_edges(fx):
    return g.customer_trend_edges(g.monthly_customers(fx.orders, fx.items), k=6)


@query("category_month_gmv")
def q_category_month_gmv(fx):
    return g.category_month_gmv(fx.orders, fx.items, fx.products, fx.translation)


@query("category_coverage")
def q_category_coverage(fx):
    return g.category_coverage(fx.orders, fx.items, fx.products, fx.translation)


@query("category_totals")
def q_category_totals(fx):
    return g.category_totals(_cat_month(fx))


@query("category_growth")
def q_category_growth(fx):
    return g.category_growth(_cat_month(fx))


@query("top_gainers_decliners")
def q_top_gainers_decliners(fx):
    return g.top_gainers_decliners(g.category_growth(_cat_month(fx)), k_up=10, k_down=5)


@query("topk_category_month_matrix")
def q_topk_category_month_matrix(fx):
    return g.topk_category_month_matrix(_cat_month(fx), k=10)


@query("region_concentration")
def q_region_concentration(fx):
    return g.region_concentration(fx.orders, fx.items, fx.customers)


@query("concentration_summary")
def q_concentration_summary(fx):
    return g.concentration_summary(_regions(fx), ks=(1, 3, 5), reach_pct=80.0)


@query("growth_kpis")
def q_growth_kpis(fx):
    return g.growth_kpis(_growth(fx), g.category_growth(_cat_month(fx)))


# ------------------------------------------------------------------ delivery

def _durations(fx: Fixtures) -> DataFrame:
    return d.fulfilment_durations(fx.orders)


@query("fulfilment_durations")
def q_fulfilment_durations(fx):
    return _durations(fx)


@query("fulfilment_summary")
def q_fulfilment_summary(fx):
    return d.fulfilment_summary(_durations(fx))


@query("stage_boxplot")
def q_stage_boxplot(fx):
    return d.stage_boxplot(_durations(fx))


@query("total_days_histogram")
def q_total_days_histogram(fx):
    return d.total_days_histogram(_durations(fx), below=60, bins=50)


@query("delay_vs_score")
def q_delay_vs_score(fx):
    return d.delay_vs_score(fx.orders, fx.reviews, by="timestamp")


@query("delay_vs_score_calendar")
def q_delay_vs_score_calendar(fx):
    return d.delay_vs_score(fx.orders, fx.reviews, by="calendar")


@query("delay_score_gap")
def q_delay_score_gap(fx):
    return d.delay_score_gap(d.delay_vs_score(fx.orders, fx.reviews))


@query("delay_by_region")
def q_delay_by_region(fx):
    return d.delay_by_region(fx.orders, fx.reviews, fx.customers, min_orders=150)


@query("delay_by_category")
def q_delay_by_category(fx):
    return d.delay_by_category(fx.orders, fx.items, fx.products, fx.translation, fx.reviews, min_orders=200)


@query("delay_by_region_extremes")
def q_delay_by_region_extremes(fx):
    return d.extremes(q_delay_by_region(fx).select("state", "order_count", "delay_rate_pct"), "delay_rate_pct", "state", 10, 5)


@query("delay_by_category_top")
def q_delay_by_category_top(fx):
    return d.extremes(q_delay_by_category(fx).select("category", "order_count", "delay_rate_pct"), "delay_rate_pct", "category", 20)


@query("delay_dose_response")
def q_delay_dose_response(fx):
    return d.delay_dose_response(fx.orders, fx.reviews)


@query("table_row_counts")
def q_table_row_counts(fx):
    return d.table_row_counts({
        "customers": fx.customers, "orders": fx.orders, "order_items": fx.items,
        "order_payments": fx.payments, "order_reviews": fx.reviews, "products": fx.products,
        "category_translation": fx.translation})


@query("stored_row_counts")
def q_stored_row_counts(fx):
    """Row counts of all stored tables, from the Parquet footers."""
    return stored_row_counts(fx.spark, {t: os.path.join(fx.sf_dir, f"{t}.parquet") for t in TEST_TABLES})


@query("data_quality_checks")
def q_data_quality_checks(fx):
    return d.data_quality_checks(fx.orders, fx.reviews)


# ------------------------------------------------------------------ customers

def _rfm(fx: Fixtures) -> DataFrame:
    # One row per customer, read by every RFM / concentration step: written once.
    return materialize(c.rfm_base(fx.orders, fx.items, as_of=AS_OF))


def _scored(fx: Fixtures) -> DataFrame:
    return materialize(c.rfm_scores(_rfm(fx)))


def _segmented(fx: Fixtures) -> DataFrame:
    return c.rfm_segments(_scored(fx))


def _cohorts(fx: Fixtures) -> DataFrame:
    return materialize(c.cohort_repurchase(fx.orders))


def _gaps(fx: Fixtures) -> DataFrame:
    return materialize(c.repurchase_gap_distribution(fx.orders))


def _preference(fx: Fixtures) -> DataFrame:
    return materialize(c.group_category_preference(fx.orders, fx.items, fx.products, fx.translation,
                                                   _segmented(fx)))


@query("frequency_value_share")
def q_frequency_value_share(fx):
    return c.frequency_value_share(fx.orders, fx.items, edges=(1, 2, 5))


@query("cohort_repurchase")
def q_cohort_repurchase(fx):
    return c.cohort_repurchase(fx.orders)


@query("cohort_summary")
def q_cohort_summary(fx):
    return c.cohort_summary(_cohorts(fx), cutoff=COHORT_CUTOFF)


@query("repurchase_gap_distribution")
def q_repurchase_gap_distribution(fx):
    return c.repurchase_gap_distribution(fx.orders)


@query("repurchase_gap_stats")
def q_repurchase_gap_stats(fx):
    return c.repurchase_gap_stats(_gaps(fx), days=(30, 90))


@query("gap_buckets")
def q_gap_buckets(fx):
    return c.gap_buckets(_gaps(fx))


@query("rfm_base")
def q_rfm_base(fx):
    return c.rfm_base(fx.orders, fx.items, as_of=AS_OF)


@query("rfm_scores")
def q_rfm_scores(fx):
    return _scored(fx)


@query("rfm_segments")
def q_rfm_segments(fx):
    return _segmented(fx)


@query("segment_stats")
def q_segment_stats(fx):
    return c.segment_stats(_segmented(fx))


@query("f_score_diagnostics")
def q_f_score_diagnostics(fx):
    return c.f_score_diagnostics(_scored(fx))


@query("pareto_shares")
def q_pareto_shares(fx):
    return c.pareto_shares(_rfm(fx), top=(5, 10, 20), bottom=50)


@query("gini")
def q_gini(fx):
    return c.gini(_rfm(fx))


@query("lorenz_curve")
def q_lorenz_curve(fx):
    return c.lorenz_curve(_rfm(fx), points=1000)


@query("spend_summary")
def q_spend_summary(fx):
    return c.spend_summary(_rfm(fx), q=0.99)


@query("spend_histogram")
def q_spend_histogram(fx):
    return c.spend_histogram(_rfm(fx), q=0.99, bins=80)


@query("group_category_preference")
def q_group_category_preference(fx):
    return c.group_category_preference(fx.orders, fx.items, fx.products, fx.translation, _segmented(fx))


@query("group_preference_extremes")
def q_group_preference_extremes(fx):
    return c.group_preference_extremes(_preference(fx), k=8)


# Display labels of the stand-in's payment types; one is left to its code.
FIXTURE_PAYMENT_LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}


@query("group_payment_mix_labelled")
def q_group_payment_mix_labelled(fx):
    return c.group_payment_mix(fx.orders, fx.payments, _segmented(fx), labels=FIXTURE_PAYMENT_LABELS)


@query("group_payment_mix")
def q_group_payment_mix(fx):
    return c.group_payment_mix(fx.orders, fx.payments, _segmented(fx))


@query("top_spender_penetration")
def q_top_spender_penetration(fx):
    return c.top_spender_penetration(fx.orders, fx.items, fx.customers, q=0.25, min_users=50)


@query("top_spender_penetration_top")
def q_top_spender_penetration_top(fx):
    return d.extremes(q_top_spender_penetration(fx), "hv_penetration", "state", 15)


# ------------------------------------------------------------------ experiment

@query("arm_summary")
def q_arm_summary(fx):
    return x.arm_summary(fx.ab, arm="dmp_id", outcome="click", control=1)


@query("contingency")
def q_contingency(fx):
    return x.contingency(fx.ab, arm="dmp_id", outcome="click", values=(0, 1))


@query("chi_square")
def q_chi_square(fx):
    return x.chi_square(x.contingency(fx.ab), correction=True)


@query("chi_square_test")
def q_chi_square_test(fx):
    return x.chi_square_test(x.contingency(fx.ab), correction=True, alpha=0.05)


@query("diff_ci")
def q_diff_ci(fx):
    return x.diff_ci(x.arm_summary(fx.ab), control=1, treatment=2, z=1.96)


@query("launch_decision")
def q_launch_decision(fx):
    chi = x.chi_square_test(x.contingency(fx.ab))
    return x.launch_decision(chi, x.diff_ci(x.arm_summary(fx.ab)), alpha=0.05)


@query("grouped_arm_summary")
def q_grouped_arm_summary(fx):
    return x.arm_summary(fx.ab_many, experiment_id="experiment_id")


def _many_table(fx: Fixtures) -> DataFrame:
    return x.contingency(fx.ab_many, experiment_id="experiment_id", arms=(1, 2))


@query("grouped_expected_counts")
def q_grouped_expected_counts(fx):
    return x.expected_counts(_many_table(fx), experiment_id="experiment_id")


@query("grouped_chi_square")
def q_grouped_chi_square(fx):
    return x.chi_square(_many_table(fx), experiment_id="experiment_id")


def _many_ci(fx: Fixtures) -> DataFrame:
    return x.diff_ci(x.arm_summary(fx.ab_many, experiment_id="experiment_id"), experiment_id="experiment_id")


@query("grouped_diff_ci")
def q_grouped_diff_ci(fx):
    return _many_ci(fx)


@query("grouped_launch_decision")
def q_grouped_launch_decision(fx):
    chi = x.chi_square_test(_many_table(fx), experiment_id="experiment_id")
    return x.launch_decision(chi, _many_ci(fx), experiment_id="experiment_id").drop("p_value")


# ------------------------------------------------------------------ scorecard

TARGET = "target"
ROW_KEY = list(APPLICANT_KEY)


def _clean(fx: Fixtures) -> DataFrame:
    # Read by binning, WOE, encoding and fitting: written once.
    return materialize(s.clean_applicants(fx.applicants, APPLICANT_RANGES, TARGET, APPLICANT_IMPUTE))


def _clean_multi(fx: Fixtures) -> DataFrame:
    return materialize(s.clean_applicants(fx.applicants_multi, APPLICANT_RANGES, TARGET, APPLICANT_IMPUTE))


def _woe(clean: DataFrame) -> DataFrame:
    return s.woe_table(clean, s.quantile_bins(clean, APPLICANT_FEATURES, q=5), TARGET, APPLICANT_FEATURES)


def _encoded(fx: Fixtures) -> DataFrame:
    clean = _clean(fx)
    return s.woe_encode(clean, s.woe_rows(_woe(clean)), keep=[*ROW_KEY, TARGET])


def _model(fx: Fixtures):
    """IV-selected features -> WOE encoding (fitted on all rows, as the
    reference does, T11) -> hash split -> logistic regression."""
    clean = _clean_multi(fx)
    woe = s.local_copy(_woe(clean))
    selected = sorted(r["feature"] for r in s.iv_table(woe).filter("selected").select("feature").collect())
    sel_woe = woe.filter(F.col("feature").isin(selected))
    # Encoding and split are projections of the written table; the fit groups them once, scoring reads them once.
    split = s.stratified_split(s.woe_encode(clean, sel_woe, keep=[*ROW_KEY, TARGET]), ROW_KEY, TARGET, test=0.3, seed=42)
    cols = [f + "_woe" for f in selected]
    model = s.fit_logistic(split.filter(F.col("split") == "train"), cols, TARGET, C=1.0)
    return split, model, cols, sel_woe


def _predictions(fx: Fixtures) -> DataFrame:
    split, model, cols, _ = _model(fx)
    # Rounded: the optimiser's last digits depend on its stopping rule.
    return s.predict(model, split, keep=[*ROW_KEY, TARGET, "split"]).withColumn("score", F.round("score", 4))


@query("clean_applicants")
def q_clean_applicants(fx):
    return _clean(fx)


@query("label_summary")
def q_label_summary(fx):
    return s.label_summary(_clean(fx), TARGET)


@query("quantile_bins")
def q_quantile_bins(fx):
    return s.quantile_bins(_clean(fx), APPLICANT_FEATURES, q=5)


@query("woe_table")
def q_woe_table(fx):
    return _woe(_clean(fx))


@query("iv_table")
def q_iv_table(fx):
    return s.iv_table(_woe(_clean(fx)), threshold=0.02)


@query("multi_iv_table")
def q_multi_iv_table(fx):
    """Information values where the default depends on several features."""
    return s.iv_table(_woe(_clean_multi(fx)), threshold=0.02)


@query("woe_table_smooth")
def q_woe_table_smooth(fx):
    clean = _clean(fx)
    bins = s.quantile_bins(clean, APPLICANT_FEATURES, q=5)
    return s.woe_table(clean, bins, TARGET, APPLICANT_FEATURES, policy="smooth", smooth=0.5)


@query("woe_table_train")
def q_woe_table_train(fx):
    """WOE fitted on the training part only."""
    clean = _clean(fx)
    train = clean.filter(F.pmod(F.col("l_orderkey"), F.lit(10)) >= 3)  # 70 %, by key
    return s.woe_table(train, s.quantile_bins(train, APPLICANT_FEATURES, q=5), TARGET, APPLICANT_FEATURES)


@query("woe_encode")
def q_woe_encode(fx):
    return _encoded(fx)


@query("stratified_split")
def q_stratified_split(fx):
    return s.stratified_split(_encoded(fx), ROW_KEY, TARGET, test=0.3, seed=42)


@query("fit_logistic")
def q_fit_logistic(fx):
    _, model, cols, _ = _model(fx)
    return s.coefficients(model, cols, fx.spark).withColumn("coef", F.round("coef", 4))


@query("scorecard_points")
def q_scorecard_points(fx):
    _, model, cols, sel_woe = _model(fx)
    points = s.scorecard_points(sel_woe, s.coefficients(model, cols, fx.spark), pdo=50.0)
    return points.withColumn("coef", F.round("coef", 4))


@query("predict")
def q_predict(fx):
    return _predictions(fx)


@query("auc")
def q_auc(fx):
    return s.auc(_predictions(fx), label=TARGET, score="score", group="split")


@query("roc_curve")
def q_roc_curve(fx):
    return s.roc_curve(_predictions(fx), label=TARGET, score="score", group="split")


@query("ks")
def q_ks(fx):
    return s.ks(s.roc_curve(_predictions(fx), label=TARGET, score="score", group="split"), group="split")


@query("overfit_gap")
def q_overfit_gap(fx):
    return s.overfit_gap(s.auc(_predictions(fx), label=TARGET, score="score", group="split"))


# ------------------------------------------------------------------ ingest
# The given tables as the CSV files that a user has: written by Spark, then loaded as any source is.

def _csv(df: DataFrame, path: str | None = None, header: bool = True, quote_all: bool = False) -> str:
    path = path or f"{ensure_checkpoint_dir(df.sparkSession)}/mercata-csv-{uuid.uuid4().hex}"
    (df.write.option("header", header).option("quote", '"').option("escape", '"').option("quoteAll", quote_all)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _with_ddl(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the column order of the DDL, missing columns empty."""
    return df.select([F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in ECOMMERCE_SCHEMAS[table].fields])


def _source_reviews(fx: Fixtures) -> DataFrame:
    """Reviews whose messages hold line breaks, quotes and commas; every seventh title is an empty string."""
    li = fx.table("lineitem").filter(F.col("l_returnflag") != "N")
    return _with_ddl(li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"), F.col("l_orderkey").cast("string").alias("order_id"),
        (F.lit(6) - F.ceil(F.col("l_quantity") / 10)).cast("int").alias("review_score"),
        F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("Part "), "l_partkey")).alias("review_comment_title"),
        F.concat(F.lit('said "'), "l_returnflag", F.lit('",\nthen,\n"'), F.col("l_suppkey"), F.lit('"')).alias("review_comment_message")), "order_reviews")


def _source_orders(fx: Fixtures) -> DataFrame:
    """Orders with their states in capitals and padded, as a case-insensitive database may hold them."""
    o = fx.orders.withColumnsRenamed(ECOMMERCE_DDL_COLUMNS)
    return _with_ddl(o.withColumn("order_status", F.concat(F.upper("order_status"), F.lit("  "))), "orders")


def _source_items(fx: Fixtures) -> DataFrame:
    """Order items, some with an item number that is none."""
    bad = F.when(F.col("order_id") % 101 == 0, "x").otherwise(F.col("order_item_id").cast("string"))
    return _with_ddl(fx.items.withColumn("order_item_id", bad), "order_items")


def _loaded(fx: Fixtures, **sources: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(counts, tables) of CSV copies of ``sources``, loaded as one version."""
    spark, root = fx.spark, f"{ensure_checkpoint_dir(fx.spark)}/mercata-tables-{uuid.uuid4().hex}"
    folder = f"{root}/csv"
    for name, df in sources.items():
        _csv(df, f"{folder}/{name}", quote_all=name == "order_reviews")
    registry = {n: (n, ECOMMERCE_SCHEMAS[n]) for n in sources}
    counts = load_tables(spark, folder, root, registry, {"orders": normalize_text(["order_status"])}, buckets=8)
    return counts, read_tables(spark, root)


@query("ingest_counts")
def q_ingest_counts(fx):
    """Rows and malformed rows of three tables loaded from CSV."""
    return _loaded(fx, orders=_source_orders(fx), order_items=_source_items(fx), order_reviews=_source_reviews(fx))[0]


@query("ingest_reviews")
def q_ingest_reviews(fx):
    """Values with line breaks, quotes and commas come back whole; empty ones as NULL."""
    t = _loaded(fx, order_reviews=_source_reviews(fx))[1]["order_reviews"]
    return t.select("review_id", "order_id", "review_score", "review_comment_title", "review_comment_message")


@query("ingest_orders")
def q_ingest_orders(fx):
    """Typed timestamps, and a transform on the way in."""
    t = _loaded(fx, orders=_source_orders(fx))[1]["orders"]
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.select("order_id", "customer_id", "order_status", at("order_purchase_timestamp"), at("order_delivered_customer_date"))


@query("ingest_items")
def q_ingest_items(fx):
    """Decimal money; what does not parse is NULL and its row stays."""
    t = _loaded(fx, order_items=_source_items(fx))[1]["order_items"]
    return t.select("order_id", "order_item_id", "product_id", F.col("price").cast("double").alias("price"))


@query("ingest_headerless")
def q_ingest_headerless(fx):
    """A file without header under given names."""
    path = _csv(fx.ab.select("dmp_id", "user_id", "click", F.lit("x").alias("flag")), header=False)
    return read_csv(fx.spark, path, AB_SCHEMA, header=False).select("dmp_id", "user_id", "click")


@query("ingest_indexed")
def q_ingest_indexed(fx):
    """Applicants whose first column is a row index; missing incomes stay missing."""
    a = fx.applicants
    names = [f.name for f in APPLICANT_SCHEMA.fields]
    given = {"row_id": F.col("l_orderkey"), "SeriousDlqin2yrs": F.col("target"), "RevolvingUtilizationOfUnsecuredLines": F.col("f_utilisation"),
             "DebtRatio": F.col("f_debt"), "MonthlyIncome": F.col("f_income"), "NumberOfTimes90DaysLate": F.col("f_late_count")}
    path = _csv(a.select([given.get(n, F.lit(None).cast("string")).alias(n) for n in names]))
    t = read_csv(fx.spark, path, APPLICANT_SCHEMA)
    return t.select("row_id", F.col("SeriousDlqin2yrs").alias("bad"), F.col("RevolvingUtilizationOfUnsecuredLines").alias("utilisation"),
                    F.col("DebtRatio").alias("debt"), F.col("MonthlyIncome").alias("income"), F.col("NumberOfTimes90DaysLate").alias("late"))
