"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all a fit sees. With the logistic
loss l and class prior p the unbiased risk of a linear score z is
p E_P[l(z)] + (E_U[l(-z)] - p E_P[l(-z)]); the bracket estimates the risk on
negatives and is held at zero or above (a fit that drives it below is
overfitting). The prior is estimated first: a classifier of positives against
unlabelled rows ranks all rows, and the share of unlabelled rows to positive
rows in a top stretch of that ranking falls towards the prior as negatives
leave the stretch.

Every pass runs over all training rows as a Spark job that returns one row per
coefficient; only features, never texts, are read again.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.llm.text import word_hashes
from mercata.session import write_table

#: Score at or above which a document counts as good.
THRESHOLD = 0.3
RIDGE = 1e-4
STEPS = 12
#: Bins of the ranking from which the class prior is read.
BINS = 400
#: The top stretch holds at least this share of the positives.
LEAST_SHARE = 0.5

_PROSE = b".,;:'\"-?()"


def _class_masks() -> np.ndarray:
    kinds = np.zeros((256, 12), np.float64)
    for i, chars in enumerate((b"|", b"!", b"#*%$&", b"<>{}[]\\/=+_^~@`", _PROSE, b"\n\r")):
        kinds[list(chars), i] = 1
    kinds[ord("0") : ord("9") + 1, 6] = 1
    kinds[ord("A") : ord("Z") + 1, 7] = 1
    kinds[ord("a") : ord("z") + 1, 8] = 1
    kinds[128:, 9] = 1
    kinds[[32, 9], 10] = 1
    kinds[:9, 11] = 1
    return kinds


_KINDS = _class_masks()
#: Classes of a word's last byte: sentence marks, symbols.
_ENDS = np.zeros((2, 256), bool)
_ENDS[0, list(b".,;:?")] = True
_ENDS[1, list(b"|!#*%$&")] = True
FEATURES = 2 * (12 + 9) + 2


def features(text: str | None) -> np.ndarray:
    """Shape of a text, whatever its language: character classes, repetition, word lengths. Empty: all zeros."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    shares = np.bincount(data, minlength=256) @ _KINDS / len(data)
    words, start, end = word_hashes(raw)
    n = max(1, len(words))
    again = int((words[1:] == words[:-1]).sum())
    words.sort()
    lengths, last = end - start, data[end - 1]
    lines = raw.split(b"\n")
    form = np.array([
        again / n,  # a word again at once
        1 - (1 + int((words[1:] != words[:-1]).sum())) / n,
        1 - len(set(lines)) / len(lines),
        _ENDS[0][last].sum() / n, _ENDS[1][last].sum() / n,
        (lengths <= 3).sum() / n, (lengths >= 10).sum() / n, (lengths >= 20).sum() / n,
        min(1.0, int(lengths.sum()) / n / 20),
    ])
    both = np.concatenate([shares, np.maximum(form, 0)])
    out[: 2 * len(both)] = np.concatenate([both, np.sqrt(both)])
    out[-2:] = math.log1p(len(words)), math.log1p(len(data) / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    prior: float = field(default=0.5)

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -35, 35)))


def held_out(key: Column, folds: int) -> Column:
    """Whether crc32 of the key's text is 0 modulo ``folds`` (a null key counts as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def feature_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x array<float>) per input row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "x"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, x array<float>")


def _totals(rows: DataFrame, of) -> dict[int, float]:
    """Sum of ``of(x, positive)`` (a vector) over all rows, one row per entry."""
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
                total = total + of(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    return {r[0]: r[1] for r in rows.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect()}


def _vector(totals: dict[int, float], n: int) -> np.ndarray:
    return np.array([totals.get(i, 0.0) for i in range(n)])


def _newton(rows: DataFrame, model: Model, counts: tuple[float, float], prior: float | None) -> None:
    """Fit ``model.weights``: positives against unlabelled rows (prior None) or the non-negative risk at ``prior``."""
    n_p, n_u = counts
    d = FEATURES + 1

    def sums(m: Model):
        def of(x, positive):
            z = m.design(x)
            s = np.clip(z @ m.weights, -35, 35)
            g = 1 / (1 + np.exp(-s))
            p, h = positive.astype(np.float64), g * (1 - g)
            return np.concatenate([
                g @ z, (p * g) @ z, p @ z, ((z * h[:, None]).T @ z).ravel(), ((z * (p * h)[:, None]).T @ z).ravel(),
                [np.logaddexp(0, s).sum(), (p * np.logaddexp(0, s)).sum(), (p * np.logaddexp(0, -s)).sum()]])
        return of

    best, last, step, found = math.inf, model.weights.copy(), np.zeros(d), False
    for _ in range(STEPS):
        t = _vector(_totals(rows, sums(model)), 3 * d + 2 * d * d + 3)
        u_g, p_g, p_z = t[:d] / n_u, t[d : 2 * d] / n_p, t[2 * d : 3 * d] / n_p
        u_h, p_h = (t[3 * d + i * d * d : 3 * d + (i + 1) * d * d].reshape(d, d) / n for i, n in enumerate((n_u, n_p)))
        u_minus, p_minus, p_plus = t[-3] / n_u, t[-2] / n_p, t[-1] / n_p
        w = np.append(model.weights[:-1], 0.0)
        if prior is None:
            risk, grad, hess = p_plus + u_minus, u_g + p_g - p_z, u_h + p_h
            negative = 0.0
        else:
            negative = u_minus - prior * p_minus
            risk = prior * p_plus + max(0.0, negative)
            grad, hess = u_g - prior * p_z, u_h  # l(z) - l(-z) is -z: the unbiased risk is convex
        risk += 0.5 * RIDGE * w @ w
        if found and (negative < 0 or risk > best + 1e-9):
            step = step / 4  # the last step went too far: too steep, or below zero risk on negatives
            model.weights = last + step
            if np.abs(step).max() < 1e-3:
                break
            continue
        gain, best, last, found = best - risk, risk, model.weights.copy(), True
        step = -np.linalg.solve(hess + RIDGE * np.diag(np.append(np.ones(d - 1), 1e-3)), grad + RIDGE * w)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        model.weights = last + step
        if gain < 1e-5:
            break
    model.weights = last


def class_prior(rows: DataFrame, model: Model, counts: tuple[float, float]) -> float:
    """Share of positives among unlabelled rows, from both groups' histograms over the ranking."""
    def of(x, positive):
        z = np.clip(model.design(x) @ model.weights, -20, 20)
        at = np.minimum(((z + 20) / 40 * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(np.float64)

    h = _vector(_totals(rows, of), 2 * BINS)
    u, p = (np.cumsum(part[::-1]) / n for part, n in ((h[:BINS], counts[1]), (h[BINS:], counts[0])))
    wide = p >= LEAST_SHARE
    return float(np.clip((u[wide] / p[wide]).min(), 0.01, 0.99))


def fit(rows: DataFrame) -> Model:
    """Fit on ``rows`` (x, positive boolean): all rows count as unlabelled, trusted positives besides.

    Without a positive or without rows every score is 0.5.
    """
    def moments(x, positive):
        return np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)])

    t = _vector(_totals(rows, moments), 2 + 2 * FEATURES)
    n_u, n_p = t[0], t[1]
    mean = t[2 : 2 + FEATURES] / max(1.0, n_u)
    scale = np.sqrt(np.maximum(t[2 + FEATURES :] / max(1.0, n_u) - mean * mean, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(FEATURES + 1))
    if n_p == 0:
        return model
    _newton(rows, model, (n_p, n_u), None)
    model.prior = class_prior(rows, model, (n_p, n_u))
    model.weights = np.zeros(FEATURES + 1)
    _newton(rows, model, (n_p, n_u), model.prior)
    return model


def trusted(features_of: DataFrame, labels: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """Training rows (x, positive): keys outside the held-out fold; positive if any of a key's labels is 1."""
    good = labels.filter(F.col(label) == 1).select(F.col(key).alias("key"), F.lit(True).alias("good")).distinct()
    return (features_of.filter(~held_out(F.col("key"), folds)).join(good, "key", "left")
            .select("x", F.coalesce("good", F.lit(False)).alias("positive")))


def classify(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int = 5) -> DataFrame:
    """(key, held_out, score) per input row; learns from keys whose crc32 modulo ``folds`` is not 0.

    Null texts score as empty ones. Labels without a document, null labels and
    negative labels are not used.
    """
    x = write_table(feature_table(docs, key, text), "quality-features")
    model = fit(write_table(trusted(x, labels, key, label, folds), "quality-train"))

    def run(batches):
        for batch in batches:
            m = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(m))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = x.select("key", "x").mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key"), folds).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int = 5,
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    x = write_table(feature_table(docs, key, text), "quality-features")
    model = fit(write_table(trusted(x, labels, key, label, folds), "quality-train"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], np.float64).reshape(-1, FEATURES)))

    return docs.filter(score(F.coalesce(text, F.lit(""))) >= threshold)
