"""DuckDB oracle SQL for the scorecard operators, the fitted model included."""

from mercata.operators.scorecard import NEGATIVE_LABEL, POSITIVE_LABEL

FEATURES = ("f_utilisation", "f_debt", "f_rate", "f_income", "f_late_count")

CLEAN = """c0 as (
  select * from fx_applicants
  where target is not null and f_utilisation > 0 and f_rate < 13 and f_debt < 50),
clean as (
  select l_orderkey, l_partkey, l_suppkey, target, f_utilisation, f_debt, f_rate,
    coalesce(f_income, (select quantile_cont(f_income, 0.5) from c0)) as f_income, f_late_count
  from c0)"""

LONG = "long as (\n  " + "\n  union all ".join(
    f"select target as y, '{f}' as feature, cast({f} as double) as value from clean where {f} is not null"
    for f in FEATURES) + ")"

BINS = """q as (
  select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]))) as e
  from long group by feature),
bins as (
  select feature, cast(b as int) as bin, e[b + 1] as lo, e[b + 2] as hi
  from (select feature, e, unnest(range(len(e) - 1)) as b from q))"""

WOE = """cnt as (
  select b.feature, b.bin, b.lo, b.hi, count(*) as count, cast(sum(l.y) as bigint) as bad
  from long l join bins b
    on l.feature = b.feature and (l.value > b.lo or (b.bin = 0 and l.value >= b.lo)) and l.value <= b.hi
  group by all),
w as (
  select feature, bin, lo, hi, count, count - bad as good, bad,
    cast(count - bad as double) / cast(sum(count - bad) over (partition by feature) as double) as good_pct,
    cast(bad as double) / cast(sum(bad) over (partition by feature) as double) as bad_pct
  from cnt),
woe as (select *, ln(bad_pct / good_pct) as woe from w)"""

TRAIN = CLEAN.replace("f_late_count\n  from c0)", "f_late_count\n  from c0 where l_orderkey % 10 >= 3)")

SMOOTH = """padded as (
  select feature, bin, lo, hi, count, count - bad as good, bad, cast(count - bad as double) + 0.5 as g, cast(bad as double) + 0.5 as b
  from cnt),
smooth as (
  select feature, bin, lo, hi, count, good, bad, g / sum(g) over f as good_pct, b / sum(b) over f as bad_pct
  from padded window f as (partition by feature))"""


def _w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _encode(f: str) -> str:
    return (f"coalesce((select w.woe from woe w where w.feature = '{f}' and (c.{f} > w.lo or (w.bin = 0 and c.{f} >= w.lo))"
            f" and c.{f} <= w.hi), 0.0) as {f}_woe")


ENC = ("enc as (\n  select c.l_orderkey, c.l_partkey, c.l_suppkey, c.target,\n  "
       + ",\n  ".join(_encode(f) for f in FEATURES) + "\n  from clean c)")
ENCODED = (CLEAN, LONG, BINS, WOE, ENC)

# Rows go to the test part by the first 32 bits of md5(key columns and seed).
SPLIT = """parts as (
  select *, if(cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, 42)), 1, 8) as bigint) % 1000000 < 300000,
               'test', 'train') as split
  from enc)"""

# The model's stand-in: three of its features are selected.
SELECTED = ("f_debt", "f_rate", "f_utilisation")
CLEAN_MULTI = CLEAN.replace("fx_applicants", "fx_applicants_multi")
ENCODED_MULTI = (CLEAN_MULTI, LONG, BINS, WOE, ENC)


def _newton() -> str:
    """Newton's method over counts per WOE combination: minimise the summed log loss plus half the squared weights
    (C = 1, free intercept). Each step solves its linear system by Gauss-Jordan elimination, one subquery a pivot."""
    k = len(SELECTED) + 1
    x = [f"x{i}" for i in range(k - 1)] + ["1.0"]
    state = ", ".join(f"b{i}" for i in range(k))
    z = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    grad = [f"sum((n * p - y) * {v})" + (f" + b{i}" if i < k - 1 else "") for i, v in enumerate(x)]
    hess = [[f"sum(n * p * (1 - p) * {x[i]} * {x[j]})" + (" + 1" if i == j < k - 1 else "") for j in range(k)] for i in range(k)]
    system = ", ".join([f"{grad[i]} as m{i}_{k}" for i in range(k)] + [f"{hess[i][j]} as m{i}_{j}" for i in range(k) for j in range(k)])
    sql = (f"select i, {state}, {system} from (select i, {state}, n, y, {', '.join(x[:-1])}, 1 / (1 + exp(-({z}))) as p from newton, counted where i < 25)"
           f" group by i, {state}")
    for p in range(k):
        cells = ", ".join(f"m{i}_{j}" + (f" - m{i}_{p} / m{p}_{p} * m{p}_{j}" if i != p else "") + f" as m{i}_{j}" for i in range(k) for j in range(p, k + 1))
        kept = ", ".join(f"m{i}_{i}" for i in range(p))
        sql = f"select i, {state}, {kept}, {cells} from ({sql})" if p else f"select i, {state}, {cells} from ({sql})"
    step = ", ".join(f"b{i} - m{i}_{k} / m{i}_{i}" for i in range(k))
    return f"""counted as (
  select {', '.join(f'{f}_woe as x{i}' for i, f in enumerate(SELECTED))}, cast(count(*) as double) as n, cast(sum(target) as double) as y
  from parts where split = 'train' group by all),
newton as (
  select 0 as i, {', '.join(f'cast(0 as double) as b{i}' for i in range(k))}
  union all
  select i + 1, {step} from ({sql})),
fitted as (select {state} from newton where i = 25)"""


FIT = _newton()
LOGIT = f"b{len(SELECTED)} + " + " + ".join(f"b{i} * {f}_woe" for i, f in enumerate(SELECTED))

SCORED = f"""scored as (
  select l_orderkey, l_partkey, l_suppkey, target, split, round(1 / (1 + exp(-({LOGIT}))), 4) as score
  from parts, fitted)"""

CURVE = """levels as (
  select split, score, cast(sum(target) as bigint) as pos, cast(sum(1 - target) as bigint) as neg from scored group by 1, 2),
stairs as (
  select split, score, pos, neg, sum(pos) over down as pos_ge, sum(neg) over down as neg_ge,
    sum(pos) over (partition by split) as n_pos, sum(neg) over (partition by split) as n_neg
  from levels window down as (partition by split order by score desc)),
aucs as (
  select split, sum(pos * (cast(n_neg - neg_ge as double) + 0.5 * neg)) / (any_value(n_pos) * any_value(n_neg)) as auc,
    cast(any_value(n_pos) as bigint) as n_pos, cast(any_value(n_neg) as bigint) as n_neg from stairs group by split),
curve as (
  select split, score as threshold, cast(neg_ge as double) / cast(n_neg as double) as fpr,
    cast(pos_ge as double) / cast(n_pos as double) as tpr,
    cast(pos_ge as double) / cast(n_pos as double) - cast(neg_ge as double) / cast(n_neg as double) as ks_gap
  from stairs
  union all select distinct split, 'infinity'::double, 0.0, 0.0, 0.0 from stairs)"""


ORACLES = {
    "clean_applicants": _w(CLEAN) + "select * from clean",
    "label_summary": _w(CLEAN) + """
select count(*) as n, count(*) filter (where target = 1) as n_bad, count(*) filter (where target = 0) as n_good,
  cast(count(*) filter (where target = 1) as double) * 100.0 / cast(count(*) as double) as default_rate_pct
from clean""",
    "quantile_bins": _w(CLEAN, LONG, BINS) + "select * from bins",
    "woe_table": _w(CLEAN, LONG, BINS, WOE) + "select * from woe",
    "iv_table": _w(CLEAN, LONG, BINS, WOE) + """, iv as (
  select feature, sum((bad_pct - good_pct) * woe order by (bad_pct - good_pct) * woe) as iv from woe group by feature)
select feature, iv, iv > 0.02 as selected, cast(row_number() over (order by iv desc, feature) as int) as iv_rank from iv""",
    "woe_table_smooth": _w(CLEAN, LONG, BINS, WOE, SMOOTH) + "select *, ln(bad_pct / good_pct) as woe from smooth",
    "woe_table_train": _w(TRAIN, LONG, BINS, WOE) + "select * from woe",
    "woe_encode": _w(*ENCODED) + "select * from enc",
    "stratified_split": _w(*ENCODED, SPLIT) + "select * from parts",
    "multi_iv_table": _w(CLEAN_MULTI, LONG, BINS, WOE) + """, iv as (
  select feature, sum((bad_pct - good_pct) * woe order by (bad_pct - good_pct) * woe) as iv from woe group by feature)
select feature, iv, iv > 0.02 as selected, cast(row_number() over (order by iv desc, feature) as int) as iv_rank from iv""",
    "fit_logistic": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT)) + "\n" + "\nunion all ".join(
        f"select '{f}_woe' as feature, round(b{i}, 4) as coef, if(b{i} > 0, '{POSITIVE_LABEL}', '{NEGATIVE_LABEL}') as direction from fitted"
        for i, f in enumerate(SELECTED)) + f"\nunion all select '(intercept)', round(b{len(SELECTED)}, 4), null from fitted",
    "scorecard_points": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT)) + """,
coefs as (""" + " union all ".join(f"select '{f}' as feature, b{i} as b from fitted" for i, f in enumerate(SELECTED)) + """)
select feature, bin, lo, hi, woe, round(b, 4) as coef, cast(round_even(-b * woe * 50.0 / ln(2), 0) as double) as points
from woe join coefs using (feature)""",
    "predict": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT, SCORED)) + "\nselect * from scored",
    "auc": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT, SCORED, CURVE)) + "\nselect * from aucs",
    "overfit_gap": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT, SCORED, CURVE)) + """
select a.auc as auc_train, b.auc as auc_test, a.auc - b.auc as gap, if(a.auc - b.auc < 0.05, 'slight', 'significant') as overfitting
from aucs a join aucs b on a.split = 'train' and b.split = 'test'""",
    "roc_curve": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT, SCORED, CURVE)) + "\nselect * from curve",
    "ks": "with recursive " + ",\n".join((*ENCODED_MULTI, SPLIT, FIT, SCORED, CURVE)) + """
select split, max(ks_gap) as ks, arg_max(threshold, ks_gap) as ks_threshold from curve where isfinite(threshold) group by split""",
}
