"""Radix selection against numpy, and the order-preserving code against the bits of doubles."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.functions.selection import decode, order_code, quantiles, select_ranks


def _bits(x):
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def test_code_is_the_bits_of_every_kind_of_double(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), math.inf, -math.inf, 1.7976931348623157e308, 0.1, 1 / 3]
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        xs += [p, math.nextafter(p, 0), math.nextafter(p, math.inf), -p, p * r.uniform(1, 2)]
    xs += [struct.unpack(">d", r.randbytes(8))[0] for _ in range(5000)]
    xs = [x for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in order_code(df, "x", ["x"]).collect():
        assert row.code == _bits(row.x), row.x
        assert decode(row.code) == row.x
    assert [r.c for r in order_code(spark.createDataFrame([(None,), (math.nan,)], "x double"), "x", code="c").collect()] == [None, None]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    n = 5000
    cols = {"normal": rng.normal(size=n), "heavy": np.exp(rng.normal(size=n) * 40), "few": rng.integers(0, 3, n).astype(float),
            "hot": np.where(rng.random(n) < 0.6, -7.25, rng.random(n)), "cents": np.round(rng.random(n) * 1e5, 2), "near": 1e9 + rng.integers(0, 9, n) * 2.0 ** -22}
    df = spark.createDataFrame([tuple(float(v[i]) if rng.random() > 0.05 else None for v in cols.values()) for i in range(n)],
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    kept = {c: np.array([r[c] for r in df.select(c).collect() if r[c] is not None]) for c in cols}
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = quantiles(df, list(cols), probs)
    for c in cols:
        assert got[c] == pytest.approx(np.quantile(kept[c], probs), rel=1e-15, abs=0), c


def test_weights_empty_columns_and_ties(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 1, None), (10, 2, None)], "v int, c long, e double")
    assert quantiles(df, ["v", "e"], [0.5], count="c") == {"v": [1.5], "e": [None]}
    assert quantiles(df.filter("v > 99"), ["v"], [0.5, 1.0]) == {"v": [None, None]}
    ranks = select_ranks(df.select(F.lit(0).alias("f"), F.col("v").cast("bigint").alias("code"), F.lit(1).alias("c")), ["v"], ["0", "{n} - 1", "{n}"])
    assert ranks == {"v": (3, [1, 10, None])}


def test_plan_shuffles_cells_only(spark):
    """Distinct values never meet an exchange: what is shuffled is grouped by 16 bits at a time."""
    df = spark.range(200_000).select((F.col("id") * 0.37 + 1).alias("v"))
    assert quantiles(df, ["v"], [0.5])["v"][0] == pytest.approx(199_999 / 2 * 0.37 + 1, rel=1e-15)
