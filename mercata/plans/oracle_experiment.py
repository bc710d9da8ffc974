"""DuckDB oracle SQL for the experiment operators."""

ARMS = """g as (
  select dmp_id, count(*) as n, count(*) filter (where click = 1) as clicks,
    cast(count(*) filter (where click = 1) as double) / cast(count(*) as double) as click_rate
  from fx_ab group by dmp_id)"""

TABLE = """t as (
  select dmp_id, count(*) filter (where click = 0) as n_0, count(*) filter (where click = 1) as n_1,
    count(*) filter (where click not in (0, 1)) as n_other
  from fx_ab group by dmp_id)"""

CHI = """cells as (
  select dmp_id, 0 as j, cast(n_0 as double) as o from t
  union all select dmp_id, 1, cast(n_1 as double) from t),
e as (
  select dmp_id, j, o, sum(o) over (partition by dmp_id) * sum(o) over (partition by j) / sum(o) over () as e,
    sum(o) over () as n, cast(((select count(*) from t) - 1) * 1 as int) as dof
  from cells),
terms as (
  select dmp_id, n, dof, e,
    pow(case when dof = 1 then o + least(0.5, abs(e - o)) * sign(e - o) else o end - e, 2) / e as t,
    pow(o - e, 2) / e as u
  from e),
per_arm as (select dmp_id, sum(t) as t, sum(u) as u, max(n) as n, max(dof) as dof, min(e) as min_e
            from terms group by dmp_id),
chi as (select sum(t order by t) as chi2, sum(u order by u) as chi2_uncorrected, max(dof) as dof, cast(max(n) as bigint) as n,
          min(min_e) as min_expected from per_arm)"""


# One degree of freedom: P(X > x) = erfc(sqrt(x / 2)); DuckDB has no erf, so the
# oracle sums the erf Maclaurin series (accurate for the statistics seen here).
PVAL = """erf_terms as (select cast(k as double) as k from range(0, 150) t(k)),
pv as (
  select
    1.0 - 2.0 / sqrt(pi()) * sum(pow(-1.0, k) * pow(sqrt(chi2 / 2.0), 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))
      as p_value,
    1.0 - 2.0 / sqrt(pi()) * sum(pow(-1.0, k) * pow(sqrt(chi2_uncorrected / 2.0), 2 * k + 1)
      / (gamma(k + 1.0) * (2 * k + 1))) as p_value_uncorrected
  from chi, erf_terms)"""


# Grouped: one 2 x 2 table per experiment from its margins; a missing margin leaves no test.
MANY = """many as (
  select experiment_id as experiment, dmp_id, count(*) as n, sum(click) as clicks from fx_ab_many group by all),
margins as (
  select experiment, cast(sum(n) as double) as n, cast(sum(clicks) as double) as k, count(*) as arms from many group by experiment),
boxes as (
  select experiment, dmp_id, unnest(['0', '1']) as outcome, cast(unnest([many.n - clicks, clicks]) as double) as observed,
    cast(many.n as double) * unnest([margins.n - k, k]) / margins.n as expected, margins.n as total, arms
  from many join margins using (experiment)),
parts as (
  select experiment, dmp_id, min(expected) as least, any_value(total) as n, any_value(arms) as arms,
    sum(if(expected > 0, pow(greatest(abs(observed - expected) - if(arms = 2, 0.5, 0), 0), 2) / expected, null)) as t,
    sum(if(expected > 0, pow(observed - expected, 2) / expected, null)) as u
  from boxes group by all),
tests as (
  select experiment as experiment_id, if(min(least) > 0, sum(t order by t), null) as chi2,
    if(min(least) > 0, sum(u order by u), null) as chi2_uncorrected, cast(max(arms) - 1 as int) as dof,
    cast(max(n) as bigint) as n, min(least) as min_expected
  from parts group by experiment),
rates as (
  select experiment as experiment_id, max(if(dmp_id = 1, cast(clicks as double) / n, null)) as rate_control,
    max(if(dmp_id = 2, cast(clicks as double) / n, null)) as rate_treatment,
    max(if(dmp_id = 1, cast(n as double), null)) as nc, max(if(dmp_id = 2, cast(n as double), null)) as nt
  from many group by experiment)"""


def _w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


ORACLES = {
    "arm_summary": _w(ARMS) + """
select *, (click_rate - (select click_rate from g where dmp_id = 1)) * 100.0 as lift_pp,
  (click_rate / (select click_rate from g where dmp_id = 1) - 1.0) * 100.0 as rel_lift_pct
from g""",
    "contingency": _w(TABLE) + "select * from t",
    "chi_square": _w(TABLE, CHI) + "select * from chi",
    "chi_square_test": _w(TABLE, CHI, PVAL) + """
select chi.*, pv.p_value, pv.p_value_uncorrected, pv.p_value < 0.05 as significant from chi, pv""",
    "launch_decision": _w(TABLE, CHI, PVAL, ARMS) + """
select pv.p_value, d.diff,
  case when pv.p_value < 0.05 and d.diff > 0 then 'launch' else 'hold' end as decision
from pv, (select max(case when dmp_id = 2 then click_rate end) - max(case when dmp_id = 1 then click_rate end) as diff
          from g) d""",
    "diff_ci": _w(ARMS) + """, r as (
  select max(case when dmp_id = 1 then click_rate end) as rate_control,
    max(case when dmp_id = 2 then click_rate end) as rate_treatment,
    max(case when dmp_id = 1 then cast(n as double) end) as nc, max(case when dmp_id = 2 then cast(n as double) end) as nt
  from g),
s as (select rate_control, rate_treatment, rate_treatment - rate_control as diff,
        sqrt(rate_control * (1.0 - rate_control) / nc + rate_treatment * (1.0 - rate_treatment) / nt) as se from r)
select *, diff - 1.96 * se as ci_lower, diff + 1.96 * se as ci_upper, diff - 1.96 * se > 0 as ci_above_zero,
  (diff - 1.96 * se > 0) or (diff + 1.96 * se < 0) as ci_excludes_zero
from s""",
    "grouped_arm_summary": _w(MANY) + """
select experiment as experiment_id, dmp_id, n, cast(clicks as bigint) as clicks, cast(clicks as double) / n as click_rate,
  (cast(clicks as double) / n - rate_control) * 100.0 as lift_pp,
  (cast(clicks as double) / n / nullif(rate_control, 0) - 1.0) * 100.0 as rel_lift_pct
from many join rates on experiment = experiment_id""",
    "grouped_expected_counts": _w(MANY) + "select experiment as experiment_id, dmp_id, outcome, observed, expected from boxes",
    "grouped_chi_square": _w(MANY) + "select * from tests",
    "grouped_diff_ci": _w(MANY) + """, d as (
  select experiment_id, rate_control, rate_treatment, rate_treatment - rate_control as diff,
    sqrt(rate_control * (1.0 - rate_control) / nc + rate_treatment * (1.0 - rate_treatment) / nt) as se from rates)
select *, diff - 1.96 * se as ci_lower, diff + 1.96 * se as ci_upper, diff - 1.96 * se > 0 as ci_above_zero,
  (diff - 1.96 * se > 0) or (diff + 1.96 * se < 0) as ci_excludes_zero
from d""",
    # With one degree of freedom p < 0.05 is a statistic above 3.841458820694124.
    "grouped_launch_decision": _w(MANY) + """
select experiment_id, rate_treatment - rate_control as diff,
  if(chi2 > 3.841458820694124 and rate_treatment > rate_control, 'launch', 'hold') as decision
from tests join rates using (experiment_id)""",
}
