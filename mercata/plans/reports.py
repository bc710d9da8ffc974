"""Report runners over ingested tables with the e-commerce DDL names.

Each runner composes the operators of one analysis family the way the
diagnosis scripts do and returns ``{table name: DataFrame}``: the tables
behind every figure plus the summary tables (SC11: the figures themselves
are not drawn). ``write_tables`` stores them as Parquet.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from mercata.functions.columns import ECOMMERCE_DDL_COLUMNS
from mercata.operators import customers as c
from mercata.operators import delivery as d
from mercata.operators import experiment as x
from mercata.operators import growth as g
from mercata.operators import scorecard as sc
from mercata.session import materialize
from mercata.sources.ingest import MALFORMED

Tables = Mapping[str, DataFrame]


def read_tables(spark: SparkSession, tables_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables written by ``sources.ingest.ingest_tables`` (``sources.catalog.read_tables`` reads versioned ones)."""
    return {n: spark.read.parquet(os.path.join(tables_dir, n)).drop(MALFORMED) for n in names}


def growth_report(t: Tables, cols: Mapping[str, str] = ECOMMERCE_DDL_COLUMNS) -> dict[str, DataFrame]:
    """GMV trend and drivers, repurchase, category and regional structure."""
    trend = materialize(g.period_growth(g.monthly_gmv_trend(t["orders"], t["order_items"], cols=cols)))
    cat_month = materialize(g.category_month_gmv(t["orders"], t["order_items"], t["products"],
                                                 t["product_category_translation"], cols=cols))
    cat_growth = g.category_growth(cat_month)
    regions = materialize(g.region_concentration(t["orders"], t["order_items"], t["customers"], cols=cols))
    monthly = g.monthly_customers(t["orders"], t["order_items"], cols=cols)
    summary = g.trend_summary(trend)
    return {
        "growth_01_trend": trend,
        "growth_trend_summary": summary,
        "growth_driver": g.growth_driver(summary),
        "growth_02_frequency": g.purchase_frequency(t["orders"], cols=cols),
        "growth_02_repeat_rate": g.repeat_rate(t["orders"], cols=cols),
        "growth_02_monthly_customers": monthly,
        "growth_02_customer_edges": g.customer_trend_edges(monthly),
        "growth_03_category_month": cat_month,
        "growth_03_category_totals": g.category_totals(cat_month),
        "growth_03_category_growth": cat_growth,
        "growth_03_gainers_decliners": g.top_gainers_decliners(cat_growth),
        "growth_03_top10_matrix": g.topk_category_month_matrix(cat_month),
        "growth_category_coverage": g.category_coverage(t["orders"], t["order_items"], t["products"],
                                                        t["product_category_translation"], cols=cols),
        "growth_04_regions": regions,
        "growth_04_concentration": g.concentration_summary(regions),
        "growth_kpis": g.growth_kpis(trend, cat_growth),
    }


def customer_report(t: Tables, as_of: str, cohort_cutoff: str, cols: Mapping[str, str] = ECOMMERCE_DDL_COLUMNS,
                    min_users: int = 100) -> dict[str, DataFrame]:
    """Frequency, cohorts, gaps, RFM, concentration, high-value profile."""
    rfm = materialize(c.rfm_base(t["orders"], t["order_items"], as_of=as_of, cols=cols))
    scored = materialize(c.rfm_scores(rfm))
    segmented = c.rfm_segments(scored)
    cohorts = materialize(c.cohort_repurchase(t["orders"], cols=cols))
    gaps = materialize(c.repurchase_gap_distribution(t["orders"], cols=cols))
    pref = materialize(c.group_category_preference(t["orders"], t["order_items"], t["products"],
                                                   t["product_category_translation"], segmented, cols=cols))
    return {
        "user_01_frequency": c.frequency_value_share(t["orders"], t["order_items"], cols=cols),
        "user_02_cohorts": cohorts,
        "user_02_cohort_summary": c.cohort_summary(cohorts, cohort_cutoff),
        "user_02_gaps": gaps,
        "user_02_gap_stats": c.repurchase_gap_stats(gaps),
        "user_02_gap_buckets": c.gap_buckets(gaps),
        "user_03_rfm": segmented,
        "user_03_segments": c.segment_stats(segmented),
        "user_03_f_score": c.f_score_diagnostics(scored),
        "user_04_pareto": c.pareto_shares(rfm),
        "user_04_lorenz": c.lorenz_curve(rfm),
        "user_04_gini": c.gini(rfm),
        "user_04_spend_summary": c.spend_summary(rfm),
        "user_04_spend_histogram": c.spend_histogram(rfm),
        "user_05_category_preference": pref,
        "user_05_preference_extremes": c.group_preference_extremes(pref),
        "user_05_payment_mix": c.group_payment_mix(t["orders"], t["order_payments"], segmented, cols=cols,
                                                   labels=c.PAYMENT_LABELS),
        "user_05_top_spender_penetration": c.top_spender_penetration(t["orders"], t["order_items"], t["customers"],
                                                                     min_users=min_users, cols=cols),
    }


def delivery_report(t: Tables, cols: Mapping[str, str] = ECOMMERCE_DDL_COLUMNS, min_region_orders: int = 100,
                    min_category_orders: int = 200) -> dict[str, DataFrame]:
    """Fulfilment timing and delay -> review score attribution."""
    durations = materialize(d.fulfilment_durations(t["orders"], cols=cols))
    dvs = d.delay_vs_score(t["orders"], t["order_reviews"], cols=cols)
    return {
        "ux_01_durations_summary": d.fulfilment_summary(durations),
        "ux_01_stage_boxplot": d.stage_boxplot(durations),
        "ux_01_total_days_histogram": d.total_days_histogram(durations),
        "ux_02_delay_vs_score": dvs,
        "ux_02_delay_vs_score_calendar": d.delay_vs_score(t["orders"], t["order_reviews"], by="calendar", cols=cols),
        "ux_02_score_gap": d.delay_score_gap(dvs),
        "ux_03_delay_by_region": d.delay_by_region(t["orders"], t["order_reviews"], t["customers"],
                                                   min_orders=min_region_orders, cols=cols),
        "ux_04_delay_by_category": d.delay_by_category(t["orders"], t["order_items"], t["products"],
                                                       t["product_category_translation"], t["order_reviews"],
                                                       min_orders=min_category_orders, cols=cols),
        "ux_05_dose_response": d.delay_dose_response(t["orders"], t["order_reviews"], cols=cols),
        "table_row_counts": d.table_row_counts(t),
        "data_quality_checks": d.data_quality_checks(t["orders"], t["order_reviews"], cols=cols),
    }


def scorecard_report(applicants: DataFrame, features: list[str], target: str, key: list[str],
                     ranges: list[tuple[str, str, float]], impute: list[str], q: int = 5, threshold: float = 0.02,
                     test: float = 0.3, seed: int = 42, C: float = 1.0, pdo: float = 50.0,
                     base: float | None = 600.0, policy: str = "inf", smooth: float = 0.5,
                     fit_on: str = "all") -> dict[str, DataFrame]:
    """Cleaning -> quantile bins -> WOE / IV -> selection -> WOE encoding ->
    stratified split -> logistic regression -> points, AUC / ROC / KS.

    ``fit_on='all'`` fits bins and WOE on all cleaned rows before the split, as
    the reference does (T11); ``'train'`` fits them on the training rows only
    and still encodes and scores everybody. ``policy`` and ``smooth`` treat
    empty cells (T14).
    """
    clean = materialize(sc.clean_applicants(applicants, ranges, target, impute))
    parts = sc.stratified_split(clean, key, target, test=test, seed=seed)
    fitted = parts.filter(parts.split == "train").drop("split") if fit_on == "train" else clean
    bins = materialize(sc.quantile_bins(fitted, features, q))
    woe = materialize(sc.woe_table(fitted, bins, target, features, policy, smooth))
    iv = sc.iv_table(woe, threshold)
    selected = sorted(r["feature"] for r in iv.filter("selected").select("feature").collect())
    sel_woe = woe.filter(woe.feature.isin(selected))
    encoded = sc.woe_encode(clean, sc.woe_rows(sel_woe), keep=[*key, target])
    split = materialize(sc.stratified_split(encoded, key, target, test=test, seed=seed))
    cols = [f + "_woe" for f in selected]
    model = sc.fit_logistic(split.filter(split.split == "train"), cols, target, C=C)
    coefs = sc.coefficients(model, cols, applicants.sparkSession)
    scored = materialize(sc.predict(model, split, keep=[*key, target, "split"]))
    ranks = sc.score_ranks(scored, label=target, group="split")
    aucs = sc.auc(None, group="split", ranks=ranks)
    roc = sc.roc_curve(None, group="split", ranks=ranks)
    return {"score_label_summary": sc.label_summary(clean, target), "score_bins": bins, "score_woe": woe,
            "score_iv": iv, "score_coefficients": coefs,
            "score_points": sc.scorecard_points(sel_woe, coefs, pdo=pdo, base=base),
            "score_auc": aucs, "score_roc": roc, "score_ks": sc.ks(roc, group="split"),
            "score_overfit": sc.overfit_gap(aucs)}


def experiment_report(effects: DataFrame, arm: str = "dmp_id", outcome: str = "click", control=1, treatment=2,
                      experiment_id: str | None = None) -> dict[str, DataFrame]:
    """Arm rates and lift, contingency, chi-square test, CI, decision."""
    arms = materialize(x.arm_summary(effects, arm, outcome, experiment_id, control))
    chi = x.chi_square_test(x.contingency(effects, arm, outcome, experiment_id=experiment_id),
                            arm, experiment_id=experiment_id)
    ci = x.diff_ci(arms, arm, control, treatment, experiment_id=experiment_id)
    return {"ab_arms": arms, "ab_chi_square": chi, "ab_ci": ci,
            "ab_decision": x.launch_decision(chi, ci, experiment_id=experiment_id)}


def write_tables(results: Mapping[str, DataFrame], out_dir: str) -> None:
    """SC11: write every table behind a figure / summary as Parquet."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(os.path.join(out_dir, name))
