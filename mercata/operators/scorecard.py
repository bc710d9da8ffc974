"""Credit scorecard: cleaning, quantile binning, WOE / IV, WOE encoding,
stratified split, logistic regression, score points, AUC / ROC / KS.

Per-feature loops of the reference become passes over wide rows: the quantile
edges of all features come out of the same radix histograms, and all WOE
tables out of one aggregation with generated bin tests, so no row is exploded,
joined or shuffled. Logistic regression iterates over counts per distinct
feature combination. Edges, WOE tables and coefficients are small literals on
the driver (at most q rows a feature), and the fitted model scores rows as a
column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mercata.functions.expressions import as_double, ordered_sum, pct, ratio
from mercata.functions.ranking import value_ranks
from mercata.functions.selection import quantiles, select_ranks
from mercata.session import write_table

_OPS = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


# ---------------------------------------------------------------- S1 / S2

def clean_applicants(df: DataFrame, ranges: Sequence[tuple[str, str, float]], target: str,
                     impute: Sequence[str] = ()) -> DataFrame:
    """Keep rows inside every range (NULL compares false, so such rows go
    too), drop rows without a target, then fill NULLs of ``impute`` columns
    with their exact median over the remaining rows.

    NaN is treated as missing, as pandas does (Spark orders NaN above every
    number, so ``NaN > 0`` would otherwise keep the row). The medians are
    found in passes over ``df`` (an action).
    """
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    df = df.select([F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c)
                    for c in df.columns])
    cond = F.col(target).isNotNull()
    for col, op, value in ranges:
        cond = cond & _OPS[op](F.col(col), F.lit(value))
    kept = df.filter(cond)
    if not impute:
        return kept
    medians = quantiles(kept, impute, [0.5])
    return kept.select(*[F.coalesce(as_double(c), F.lit(medians[c][0]).cast("double")).alias(c) if c in impute else F.col(c)
                         for c in kept.columns])


def label_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, bad / good counts, default rate in percent."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("n_bad"),
                  F.count_if(F.col(target) == 0).alias("n_good")).select(
        "*", pct("n_bad", "n").alias("default_rate_pct"))


# ---------------------------------------------------------------- S3 .. S5

def quantile_bins(df: DataFrame, features: Sequence[str], q: int = 5) -> DataFrame:
    """S3: ``pd.qcut(q, duplicates='drop')`` bins per feature: exact quantile
    edges at 0, 1/q, ..., 1, duplicates removed; bin i is (edge_i, edge_i+1]
    with the lowest edge included in bin 0. Output: feature, bin, lo, hi, a
    local table of at most q rows a feature (an action). NULL and NaN values
    are left out, and a feature with a single distinct edge has no bins."""
    edges = quantiles(df, features, [i / q for i in range(q + 1)])
    rows = []
    for f in features:
        e = list(dict.fromkeys(x for x in edges[f] if x is not None))
        rows += [(f, i, lo, hi) for i, (lo, hi) in enumerate(zip(e, e[1:]))]
    return df.sparkSession.createDataFrame(rows, "feature string, bin int, lo double, hi double")


def _in_bin(value: Column, bin_: Column, lo: Column, hi: Column) -> Column:
    return ((value > lo) | ((bin_ == 0) & (value >= lo))) & (value <= hi)


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _bin_number(v: str, rows: Sequence[Row]) -> str:
    """SQL for the number of the bin that holds ``v``, NULL outside all of them.

    Bins that follow on one another, as quantile bins do, are counted off:
    short code that the JVM compiles; others are tested one by one.
    """
    following = all(a["hi"] == b["lo"] and a["bin"] + 1 == b["bin"] for a, b in zip(rows, rows[1:])) and rows[0]["bin"] == 0
    if following:
        steps = "".join(f" + cast({v} > {_double(r['hi'])} as int)" for r in rows[:-1])
        return f"if({v} >= {_double(rows[0]['lo'])} and {v} <= {_double(rows[-1]['hi'])}, 0{steps}, null)"
    return "case " + " ".join(f"when ({v} > {_double(r['lo'])} or ({r['bin']} = 0 and {v} >= {_double(r['lo'])})) and {v} <= {_double(r['hi'])} then {r['bin']}"
                              for r in rows) + " end"


#: Cells counted by one aggregation; more features than fit take another one over the same scan.
CELLS_AT_ONCE = 200


def _bin_counts(df: DataFrame, bins: Sequence[Row], target: str, features: set[str]) -> DataFrame:
    """Rows and target sum per bin: (feature, bin, lo, hi, count, bad), bins without rows left out.

    Each row gets one bin number a feature by generated comparisons; every
    (feature, bin) is one conditional count and sum of a single aggregation,
    whose one row is unpivoted.
    """
    by_feature: dict[str, list[Row]] = {}
    for b in bins:
        if b["feature"] in features:
            by_feature.setdefault(b["feature"], []).append(b)
    groups: list[list[tuple[str, list[Row]]]] = [[]]
    for item in by_feature.items():
        if groups[-1] and sum(len(x) for _, x in groups[-1]) + len(item[1]) > CELLS_AT_ONCE:
            groups.append([])
        groups[-1].append(item)
    out = None
    for group in groups:
        numbers, cells = [], []
        for i, (feature, rows) in enumerate(group):
            numbers.append(f"{_bin_number(f'cast(`{feature}` as double)', rows)} as b{i}")
            for r in rows:
                cells.append(f"named_struct('feature', '{feature}', 'bin', {r['bin']}, 'lo', {_double(r['lo'])}, 'hi', {_double(r['hi'])}, "
                             f"'count', count_if(b{i} = {r['bin']}), 'bad', cast(sum(if(b{i} = {r['bin']}, y, null)) as bigint)) as c{len(cells)}")
        if not cells:
            continue
        one = df.selectExpr(f"`{target}` as y", *numbers).agg(*[F.expr(c) for c in cells])
        t = one.unpivot([], [f"c{k}" for k in range(len(cells))], "k", "c").select("c.*").filter("count > 0")
        out = t if out is None else out.unionByName(t)
    if out is None:
        return df.sparkSession.createDataFrame([], "feature string, bin int, lo double, hi double, count bigint, bad bigint")
    return out


def woe_table(df: DataFrame, bins: DataFrame, target: str, features: Sequence[str], policy: str = "inf",
              smooth: float = 0.5) -> DataFrame:
    """Per (feature, bin) count, bad, good, shares and WOE = ln(bad% / good%).

    Zero cells (T14): ``inf`` gives +-inf as numpy would (IV inf, feature
    selected); ``smooth`` adds ``smooth`` to every good and bad count;
    ``drop`` leaves such bins out. ``bins`` (at most q rows a feature) is read
    to the driver and becomes tests in the one aggregation over ``df``.
    """
    spec = sorted(bins.select("feature", "bin", "lo", "hi").collect(), key=lambda r: (r["feature"], r["bin"]))
    g = _bin_counts(df, spec, target, set(features))
    g = g.withColumn("good", F.col("count") - F.col("bad"))
    if policy == "drop":
        g = g.filter((F.col("bad") > 0) & (F.col("good") > 0))
    add = F.lit(float(smooth) if policy == "smooth" else 0.0)
    per_f = Window.partitionBy("feature")  # bins of one feature (<= q rows)
    good_pct = ratio(as_double("good") + add, F.sum(as_double("good") + add).over(per_f))
    bad_pct = ratio(as_double("bad") + add, F.sum(as_double("bad") + add).over(per_f))
    g = g.select("feature", "bin", "lo", "hi", "count", "good", "bad",
                 good_pct.alias("good_pct"), bad_pct.alias("bad_pct"))
    woe = (F.when((F.col("bad_pct") == 0) & (F.col("good_pct") == 0), F.lit(float("nan")))
           .when(F.col("bad_pct") == 0, F.lit(float("-inf")))
           .when(F.col("good_pct") == 0, F.lit(float("inf")))
           .otherwise(F.ln(F.col("bad_pct") / F.col("good_pct"))))
    return g.select("*", woe.alias("woe"))


def iv_table(woe: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Information value per feature, selection flag (iv > threshold), rank.
    A NaN IV is not selected (Spark orders NaN above every number)."""
    # At most q bins per feature: summed in a fixed order.
    g = woe.groupBy("feature").agg(ordered_sum((F.col("bad_pct") - F.col("good_pct")) * F.col("woe")).alias("iv"))
    return (g.select("feature", "iv", (~F.isnan("iv") & (F.col("iv") > threshold)).alias("selected"),
                     F.row_number().over(Window.orderBy(F.desc("iv"), "feature")).alias("iv_rank")))


# ---------------------------------------------------------------- S6 / S7

def local_copy(table: DataFrame) -> DataFrame:
    """A small table (bins, WOE: at most q rows a feature) computed once and kept as literals (an action)."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def woe_rows(woe: DataFrame) -> list[Row]:
    """The WOE table on the driver, in order: at most q rows per feature (an action)."""
    return woe.select("feature", "bin", "lo", "hi", "woe").orderBy("feature", "bin").collect()


def woe_encode(df: DataFrame, woe: Sequence[Row] | DataFrame, keep: Sequence[str], default: float = 0.0,
               suffix: str = "_woe") -> DataFrame:
    """Replace each binned feature by its bin's WOE (``default`` when the
    value is NULL or outside every bin).

    The WOE table comes as ``woe_rows`` (a DataFrame is read to the driver
    here) and turns into a CASE expression per feature, so encoding is a narrow
    projection: no join and no shuffle of the rows.
    """
    table = woe_rows(woe) if isinstance(woe, DataFrame) else woe
    by_feature: dict[str, list] = {}
    for r in table:
        by_feature.setdefault(r["feature"], []).append(r)
    cols = [F.col(c) for c in keep]
    for feature, rows in sorted(by_feature.items()):
        v = as_double(feature)
        expr = None
        for r in rows:
            cond = _in_bin(v, F.lit(r["bin"]), F.lit(r["lo"]), F.lit(r["hi"]))
            expr = F.when(cond, F.lit(r["woe"])) if expr is None else expr.when(cond, F.lit(r["woe"]))
        cols.append(expr.otherwise(F.lit(float(default))).alias(feature + suffix))
    return df.select(*cols)


#: Classes of a target that an exact split may have.
MOST_CLASSES = 1000


def stratified_split(df: DataFrame, key: Sequence[str], target: str, test: float = 0.3, seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Deterministic train / test split.

    Default: a row is 'test' when the first 32 bits of md5(key columns and seed,
    joined by '|') fall in the lowest ``test`` share modulo a million: about
    ``test`` of every class, no shuffle, stable under recomputation and the same
    in any engine that has md5. ``exact=True``: within each class the
    ceil(test * n_class) rows with the smallest hashes are 'test' (equal
    hashes at the border stay together). The border is found by selection over
    ``df`` (an action) and compared row by row: no join, no sort.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    if not exact:
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1_000_000
        return df.select("*", F.when(bucket < int(round(test * 1_000_000)), "test").otherwise("train").alias("split"))
    classes = [r[0] for r in df.select(target).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"an exact split is by at most {MOST_CLASSES} classes; {target!r} has more")
    # The last test row's hash per class, null-safe: rows without a target form a class of their own.
    which = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        which = F.when(F.col(target).eqNullSafe(F.lit(c)), i).otherwise(which)
    last = select_ranks(df.select(which.alias("f"), h.alias("code"), F.lit(1).alias("c")), [str(i) for i in range(len(classes))],
                        [f"ceil({{n}} * {float(test)!r}D) - 1"])
    cut = F.lit(None).cast("bigint")
    for i, c in enumerate(classes):
        code = last[str(i)][1][0] if str(i) in last else None
        cut = F.when(F.col(target).eqNullSafe(F.lit(c)), F.lit(-1 if code is None else code).cast("bigint")).otherwise(cut)
    return df.select("*", F.when(h <= cut, "test").otherwise("train").alias("split"))


# ---------------------------------------------------------------- S8 .. S10

@dataclass(frozen=True)
class LogisticModel:
    """A fitted model: one coefficient a feature and the intercept."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    @classmethod
    def from_table(cls, coefs: DataFrame) -> LogisticModel:
        """The model of a stored ``coefficients`` table (a handful of rows, an action)."""
        rows = {r["feature"]: r["coef"] for r in coefs.select("feature", "coef").collect()}
        features = tuple(sorted(f for f in rows if f != INTERCEPT))
        return cls(features, tuple(rows[f] for f in features), rows[INTERCEPT])

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for f, c in zip(self.features, self.coef):
            z = z + F.lit(c) * as_double(f)
        return z

    def probability(self) -> Column:
        """P(bad) as an expression in generated code; NULL where a feature is."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))


INTERCEPT = "(intercept)"


def fit_logistic(train: DataFrame, features: Sequence[str], target: str, C: float = 1.0, max_iter: int = 100,
                 tol: float = 1e-12) -> LogisticModel:
    """L2 logistic regression as sklearn's ``LogisticRegression(C)``:
    min 1/2 ||w||^2 + C * sum(logloss) with a free intercept.

    Rows enter once: as counts and positives per distinct combination of the
    features (at most (q + 1)^features for WOE values), written as a table.
    Newton's method runs over that table; a step that raises the loss is
    halved. Rows with a NULL feature or target are left out. An action.
    """
    cols = list(features)
    rows = train.select(*[as_double(f).alias(f"x{i}") for i, f in enumerate(cols)], as_double(target).alias("y")).dropna()
    cells = write_table(rows.groupBy(*[f"x{i}" for i in range(len(cols))]).agg(
        as_double(F.count(F.lit(1))).alias("n"), F.sum("y").alias("y")), "logit-cells")
    k = len(cols) + 1
    x = [*[F.col(f"x{i}") for i in range(len(cols))], F.lit(1.0)]

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian."""
        z = sum((F.lit(float(b)) * v for b, v in zip(beta, x)), F.lit(0.0))
        e = F.exp(-F.abs(z))
        one = cells.select(*cells.columns, z.alias("z"), e.alias("e"), (F.when(z >= 0, 1.0).otherwise(e) / (1.0 + e)).alias("p"))
        rest = F.col("n") * F.col("p") - F.col("y")
        weight = F.col("n") * F.col("p") * (1.0 - F.col("p"))
        sums = [F.sum(F.col("n") * (F.greatest(F.col("z"), F.lit(0.0)) + F.log1p("e")) - F.col("y") * F.col("z")).alias("loss")]
        sums += [F.sum(rest * v).alias(f"g{i}") for i, v in enumerate(x)]
        sums += [F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = one.agg(*sums).first()
        if r["loss"] is None:
            raise ValueError("no rows to fit")
        w = np.append(beta[:-1], 0.0)  # the intercept is free
        grad = w + C * np.array([r[f"g{i}"] for i in range(k)])
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * C + np.diag([1.0] * (k - 1) + [0.0])
        loss = 0.5 * float(w @ w) + C * r["loss"]
        if not (math.isfinite(loss) and np.isfinite(grad).all() and np.isfinite(hess).all()):
            raise ValueError("a feature is infinite (a WOE of an empty cell?): use policy 'smooth' or 'drop'")
        return loss, grad, hess

    beta = np.zeros(k)
    loss, grad, hess = at(beta)
    for _ in range(max_iter):
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        if np.abs(step).max() < tol:
            break
        while True:
            new = at(beta - step)
            if new[0] <= loss + 1e-12 * abs(loss) or np.abs(step).max() < tol:
                break
            step = step / 2
        beta, (loss, grad, hess) = beta - step, new
    return LogisticModel(tuple(cols), tuple(float(b) for b in beta[:-1]), float(beta[-1]))


# Direction labels for coefficient signs.
POSITIVE_LABEL = "positive (raises default risk)"
NEGATIVE_LABEL = "negative (protective)"


def coefficients(model: LogisticModel, features: Sequence[str], spark) -> DataFrame:
    """Feature, coefficient, direction label; intercept as '(intercept)'.
    (A handful of driver-side numbers from the fitted model.)"""
    by = dict(zip(model.features, model.coef))
    rows = [(f, by[f]) for f in features]
    rows.append((INTERCEPT, model.intercept))
    df = spark.createDataFrame(rows, "feature string, coef double")
    return df.select("*", F.when(F.col("feature") == INTERCEPT, F.lit(None))
                     .when(F.col("coef") > 0, POSITIVE_LABEL).otherwise(NEGATIVE_LABEL).alias("direction"))


def predict(model: LogisticModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """P(bad) per row, a projection of the rows."""
    return df.select(*keep, model.probability().alias("score"))


def scorecard_points(woe: DataFrame, coefs: DataFrame, pdo: float = 50.0, suffix: str = "_woe",
                     base: float | None = None) -> DataFrame:
    """Points per bin = round_half_even(-coef * woe * pdo / ln 2). The
    base score is not added to the points (T13: the reference only reports
    it); pass ``base`` to carry it as a separate ``base_score`` column."""
    factor = pdo / math.log(2)
    c = coefs.select(F.regexp_replace("feature", suffix + "$", "").alias("feature"), "coef")
    j = woe.join(F.broadcast(c), "feature")  # one row per model feature
    out = j.select("feature", "bin", "lo", "hi", "woe", "coef",
                   F.bround(-F.col("coef") * F.col("woe") * F.lit(factor), 0).alias("points"))
    return out if base is None else out.withColumn("base_score", F.lit(float(base)))


# ---------------------------------------------------------------- S11 .. S13

def score_ranks(scored: DataFrame, label: str = "target", score: str = "score", group: str | None = None) -> DataFrame:
    """Positives and rows per distinct score and around it, written once: what ``auc`` and ``roc_curve`` read
    (hand the result to both as ``ranks``)."""
    return value_ranks(scored.select(*( [group] if group else []), score, as_double(label).alias("_pos")),
                       score, group=group, weight="_pos")


def auc(scored: DataFrame | None, label: str = "target", score: str = "score", group: str | None = None,
        ranks: DataFrame | None = None) -> DataFrame:
    """ROC AUC = P(score_pos > score_neg) + 1/2 P(tie), from per-score
    positive / negative counts (distinct-score prefix sums, no global sort)."""
    r = score_ranks(scored, label, score, group) if ranks is None else ranks
    neg_lt = F.col("cnt_lt") - F.col("w_lt")
    neg_here = F.col("cnt") - F.col("wsum")
    num = F.sum(F.col("wsum") * (neg_lt + F.lit(0.5) * neg_here))
    keys = [group] if group else []
    a = r.groupBy(*keys).agg(num.alias("_num"), F.max("w_total").alias("n_pos"), F.max("n_total").alias("_n"))
    # A group of one class has no AUC: NULL.
    return a.select(*keys, F.try_divide("_num", F.col("n_pos") * (F.col("_n") - F.col("n_pos"))).alias("auc"),
                    F.col("n_pos").cast("bigint").alias("n_pos"), (F.col("_n") - F.col("n_pos")).cast("bigint")
                    .alias("n_neg"))


def roc_curve(scored: DataFrame | None, label: str = "target", score: str = "score", group: str | None = None,
              ranks: DataFrame | None = None) -> DataFrame:
    """One point per distinct score threshold (predict bad when
    score >= threshold): fpr, tpr and the KS gap tpr - fpr. The curve starts
    at (0, 0), with an infinite threshold."""
    r = score_ranks(scored, label, score, group) if ranks is None else ranks
    pos_ge = F.col("w_gt") + F.col("wsum")
    neg_ge = (F.col("cnt_gt") - F.col("w_gt")) + (F.col("cnt") - F.col("wsum"))
    n_neg = F.col("n_total") - F.col("w_total")
    keys = [group] if group else []
    point = F.struct(as_double("value").alias("threshold"), ratio(neg_ge, n_neg).alias("fpr"), ratio(pos_ge, "w_total").alias("tpr"))
    start = F.struct(F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(F.col("cnt_gt") == 0, F.array(start, point)).otherwise(F.array(point))
    out = r.select(*keys, F.explode(points).alias("p")).select(*keys, "p.*")
    return out.withColumn("ks_gap", F.col("tpr") - F.col("fpr"))


def ks(roc: DataFrame, group: str | None = None) -> DataFrame:
    """KS = max(tpr - fpr) and the threshold where it is reached."""
    keys = [group] if group else []
    return roc.filter(F.col("threshold") < math.inf).groupBy(*keys).agg(
        F.max("ks_gap").alias("ks"), F.max_by("threshold", F.struct("ks_gap", "threshold")).alias("ks_threshold"))


def overfit_gap(aucs: DataFrame, group: str = "split", train: str = "train", test: str = "test",
                slight_below: float = 0.05) -> DataFrame:
    """AUC(train) - AUC(test) and the verdict ('slight' below 0.05)."""
    a = aucs.agg(F.max(F.when(F.col(group) == train, F.col("auc"))).alias("auc_train"),
                 F.max(F.when(F.col(group) == test, F.col("auc"))).alias("auc_test"))
    gap = F.col("auc_train") - F.col("auc_test")
    return a.select("*", gap.alias("gap"),
                    F.when(gap < slight_below, "slight").otherwise("significant").alias("overfitting"))
