"""A/B test readout: arm rates and lift, contingency table, chi-square test,
confidence interval of the rate difference, launch decision.

One ``groupBy(experiment, arm)`` over the raw events produces everything;
all later steps run on that aggregated table (arms x experiments rows).
``experiment_id`` lets thousands of experiments be read out in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.expressions import as_double, ordered_sum, ratio
from mercata.functions.stats import chi2_sf

EXP = "_experiment"


def _keys(experiment_id: str | None) -> list[Column]:
    return [F.col(experiment_id).alias(EXP)] if experiment_id else [F.lit(0).alias(EXP)]


def _finish(df: DataFrame, experiment_id: str | None) -> DataFrame:
    return df.withColumnRenamed(EXP, experiment_id) if experiment_id else df.drop(EXP)


def arm_readout(counts: DataFrame, arm: str = "dmp_id", control=1, experiment_id: str | None = None) -> DataFrame:
    """Rates and lift from per-arm totals (``arm, n, clicks``, optionally per
    experiment): click_rate, lift_pp (rate - control rate, percentage points)
    and rel_lift_pct (rate / control rate - 1, percent)."""
    g = counts.select(*_keys(experiment_id), arm, "n", "clicks").withColumn("click_rate", ratio("clicks", "n"))
    per_exp = Window.partitionBy(EXP)  # arms of one experiment
    ctrl = F.max(F.when(F.col(arm) == control, F.col("click_rate"))).over(per_exp)
    out = g.select("*", ((F.col("click_rate") - ctrl) * F.lit(100.0)).alias("lift_pp"),
                   ((F.try_divide(F.col("click_rate"), ctrl) - F.lit(1.0)) * F.lit(100.0)).alias("rel_lift_pct"))
    return _finish(out, experiment_id)


def arm_counts(df: DataFrame, arm: str = "dmp_id", outcome: str = "click", experiment_id: str | None = None,
               positive=1) -> DataFrame:
    """Per (experiment, arm) users and positives: the one pass over events."""
    keys = ([F.col(experiment_id)] if experiment_id else []) + [F.col(arm)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 F.count_if(F.col(outcome) == positive).alias("clicks"))


def arm_summary(df: DataFrame, arm: str = "dmp_id", outcome: str = "click", experiment_id: str | None = None,
                control=1, positive=1) -> DataFrame:
    """AB1: per arm users, positives, rate, and lift against the control arm
    (one scan instead of one masked scan per number)."""
    return arm_readout(arm_counts(df, arm, outcome, experiment_id, positive), arm, control, experiment_id)


#: Distinct outcomes that ``contingency`` looks up by itself.
MOST_OUTCOMES = 1000


def contingency(df: DataFrame, arm: str = "dmp_id", outcome: str = "click", values: Sequence | None = (0, 1),
                experiment_id: str | None = None, arms: Sequence | None = None) -> DataFrame:
    """AB2: arm x outcome counts, one column ``n_<value>`` per outcome value and
    ``n_other`` for any other outcome; empty cells are 0, NULL outcomes are not
    counted. ``values=None`` takes the outcomes that occur (an action; more than
    ``MOST_OUTCOMES`` are refused). All arms
    present are kept (T21) unless ``arms`` names them.
    """
    if arms is not None:
        df = df.filter(F.col(arm).isin(list(arms)))
    if values is None:
        values = sorted(r[0] for r in df.select(outcome).distinct().filter(F.col(outcome).isNotNull())
                        .limit(MOST_OUTCOMES + 1).collect())
        if len(values) > MOST_OUTCOMES:
            raise ValueError(f"{outcome!r} has more than {MOST_OUTCOMES} outcomes: name the values to count")
    cells = [F.count_if(F.col(outcome) == v).alias(f"n_{v}") for v in values]
    other = F.count_if(F.col(outcome).isNotNull() & ~F.col(outcome).isin(list(values))).alias("n_other")
    g = df.groupBy(*_keys(experiment_id), F.col(arm).alias(arm)).agg(*cells, other)
    return _finish(g, experiment_id)


def expected_counts(table: DataFrame, arm: str = "dmp_id", values: Sequence | None = None,
                    experiment_id: str | None = None) -> DataFrame:
    """AB3: per cell of the contingency table ``observed`` and ``expected`` = row total x
    column total / N (NULL for an empty experiment). One row per (experiment, arm, outcome).

    Outcomes outside the table's columns would make N, and the test, wrong: any raises.
    """
    if values is None:
        values = [c[2:] for c in table.columns if c.startswith("n_") and c != "n_other"]
    if "n_other" in table.columns:
        whole = F.when(F.col("n_other") > 0, F.raise_error(F.lit("outcomes outside the contingency table's values")).cast("long"))
        table = table.withColumn(f"n_{values[0]}", F.coalesce(whole, F.col(f"n_{values[0]}")))
    t = table.select(*_keys(experiment_id), arm, *[f"n_{v}" for v in values])
    cells = t.select(EXP, arm, F.explode(F.array(*[
        F.struct(F.lit(str(v)).alias("outcome"), F.col(f"n_{v}").cast("double").alias("observed")) for v in values
    ])).alias("c")).select(EXP, arm, "c.*")
    total = F.sum("observed").over(Window.partitionBy(EXP))  # cells of one experiment
    row = F.sum("observed").over(Window.partitionBy(EXP, arm))
    column = F.sum("observed").over(Window.partitionBy(EXP, "outcome"))
    return _finish(cells.select("*", F.try_divide(row * column, total).alias("expected")), experiment_id)


def chi_square(table: DataFrame, arm: str = "dmp_id", values: Sequence | None = None, correction: bool = True,
               experiment_id: str | None = None) -> DataFrame:
    """AB3: Pearson chi-square of independence on the contingency table.

    With one degree of freedom and ``correction`` the Yates continuity
    correction moves each observed count up to 0.5 towards its expectation
    (scipy's default). Returns chi2 (as tested), chi2_uncorrected, dof, n and
    the smallest expected count. An experiment with an empty row or column has
    an expected count of 0 and no test: its chi2 is NULL.
    """
    cells = expected_counts(table, arm, values, experiment_id).select(*_keys(experiment_id), arm, "outcome", "observed", "expected")
    per_exp = Window.partitionBy(EXP)  # cells of one experiment
    n_rows, n_columns = F.size(F.collect_set(arm).over(per_exp)), F.size(F.collect_set("outcome").over(per_exp))
    e = cells.select("*", F.sum("observed").over(per_exp).alias("n"), ((n_rows - 1) * (n_columns - 1)).alias("dof"))
    o, x = F.col("observed"), F.col("expected")
    shifted = o + F.least(F.lit(0.5), F.abs(x - o)) * F.signum(x - o)
    corrected = F.when((F.col("dof") == 1) & F.lit(correction), shifted).otherwise(o)
    terms = e.select(EXP, arm, "n", "dof", "expected", F.try_divide(F.pow(corrected - x, 2), x).alias("t"),
                     F.try_divide(F.pow(o - x, 2), x).alias("u"))
    # Sum each arm's cells, then the arms (few rows per experiment).
    per_arm = terms.groupBy(EXP, arm).agg(
        F.sum("t").alias("t"), F.sum("u").alias("u"), F.max("n").alias("n"), F.max("dof").alias("dof"),
        F.min("expected").alias("min_e"))
    tested = F.min("min_e") > 0
    out = per_arm.groupBy(EXP).agg(F.when(tested, ordered_sum("t")).alias("chi2"),
                                   F.when(tested, ordered_sum("u")).alias("chi2_uncorrected"),
                                   F.max("dof").alias("dof"), F.max("n").cast("bigint").alias("n"),
                                   F.min("min_e").alias("min_expected"))
    return _finish(out, experiment_id)


def chi_square_test(table: DataFrame, arm: str = "dmp_id", values: Sequence | None = None, correction: bool = True,
                    alpha: float = 0.05, experiment_id: str | None = None) -> DataFrame:
    """AB3 with p-values (upper chi-square tail) and the significance flag."""
    chi = chi_square(table, arm, values, correction, experiment_id)
    tail = lambda c: chi2_sf(F.col(c), F.col("dof"))
    return chi.select("*", tail("chi2").alias("p_value"), tail("chi2_uncorrected").alias("p_value_uncorrected")
                      ).withColumn("significant", F.col("p_value") < alpha)


def diff_ci(arms: DataFrame, arm: str = "dmp_id", control=1, treatment=2, z: float = 1.96,
            experiment_id: str | None = None) -> DataFrame:
    """AB4: treatment - control rate, unpooled standard error, z-interval."""
    a = arms.select(*_keys(experiment_id), arm, "n", "click_rate")
    is_c, is_t = F.col(arm) == control, F.col(arm) == treatment
    g = a.groupBy(EXP).agg(
        F.max(F.when(is_c, F.col("click_rate"))).alias("rate_control"),
        F.max(F.when(is_t, F.col("click_rate"))).alias("rate_treatment"),
        F.max(F.when(is_c, as_double("n"))).alias("_nc"), F.max(F.when(is_t, as_double("n"))).alias("_nt"))
    rc, rt = F.col("rate_control"), F.col("rate_treatment")
    se = F.sqrt(rc * (F.lit(1.0) - rc) / F.col("_nc") + rt * (F.lit(1.0) - rt) / F.col("_nt"))
    out = g.select(EXP, "rate_control", "rate_treatment", (rt - rc).alias("diff"), se.alias("se"))
    out = out.select("*", (F.col("diff") - F.lit(z) * F.col("se")).alias("ci_lower"),
                     (F.col("diff") + F.lit(z) * F.col("se")).alias("ci_upper"))
    out = out.select("*", (F.col("ci_lower") > 0).alias("ci_above_zero"),
                     ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("ci_excludes_zero"))
    return _finish(out, experiment_id)


def launch_decision(chi: DataFrame, ci: DataFrame, alpha: float = 0.05, experiment_id: str | None = None) -> DataFrame:
    """AB5: launch when the test is significant and the treatment is better."""
    if experiment_id:
        # One row per experiment on each side: an equi-join on the key.
        j = chi.select(experiment_id, "p_value").join(ci.select(experiment_id, "diff"), experiment_id)
    else:
        # A single experiment: its p-value is a scalar subquery.
        j = ci.select(chi.select("p_value").scalar().alias("p_value"), "diff")
    return j.withColumn("decision", F.when((F.col("p_value") < alpha) & (F.col("diff") > 0), "launch")
                        .otherwise("hold"))
