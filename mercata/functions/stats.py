"""Distribution tails for test statistics, as JVM expressions.

Spark SQL has no ``erf`` or incomplete gamma function. The upper tail of the
chi-square distribution is the regularised upper incomplete gamma function
Q(dof / 2, x / 2): below dof / 2 + 1 one minus its power series, above it a
continued fraction (modified Lentz), each folded over a sequence whose length
follows from dof. Everything runs in one projection over aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 15  # arguments are moved up by this much before Stirling's series
#: Coefficients B(2k) / (2k (2k - 1)) of Stirling's series for the logarithm of the gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_HALF_LOG_2PI = 0.9189385332046727
_TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """ln Gamma(a) for a > 0."""
    z = a + float(_SHIFT)
    series, power = F.lit(0.0), F.lit(1.0) / z
    for c in _STIRLING:
        series = series + F.lit(c) * power
        power = power / (z * z)
    below = F.lit(0.0)
    for i in range(_SHIFT):
        below = below + F.ln(a + float(i))
    return (z - 0.5) * F.ln(z) - z + _HALF_LOG_2PI + series - below


def _steps(a: Column) -> Column:
    """1..n with n enough terms for 1e-16: both expansions need some sqrt(a) of them next to x = a + 1."""
    return F.sequence(F.lit(1), (F.lit(300) + F.lit(40) * F.ceil(F.sqrt(a))).cast("int"))


def _lower_series(a: Column, x: Column) -> Column:
    """sum over n of x^n / (a (a + 1) ... (a + n))."""
    first = F.lit(1.0) / a
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))
    return F.aggregate(_steps(a), start, step)["total"]


def _upper_fraction(a: Column, x: Column) -> Column:
    """The continued fraction of Gamma(a, x) / (x^a e^-x)."""
    safe = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    b0 = x + 1.0 - a
    d0 = F.lit(1.0) / safe(b0)
    start = F.struct(b0.alias("b"), F.lit(1.0 / _TINY).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, i: Column) -> Column:
        an = -i * (i - a)
        b = s["b"] + 2.0
        d = F.lit(1.0) / safe(an * s["d"] + b)
        c = safe(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))
    return F.aggregate(_steps(a), start, step)["h"]


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(X > x) of the chi-square distribution with any ``dof`` > 0.

    NULL for a NULL or NaN argument and where ``dof`` is not positive; 1 for
    x <= 0, 0 for an infinite x.
    """
    x, dof = x.cast("double"), dof.cast("double")
    a, t = dof / 2.0, x / 2.0
    scale = F.exp(a * F.ln(t) - t - log_gamma(a))
    below = F.greatest(F.lit(0.0), 1.0 - scale * _lower_series(a, t))
    above = scale * _upper_fraction(a, t)
    known = x.isNotNull() & ~F.isnan(x) & dof.isNotNull() & ~F.isnan(dof) & (dof > 0)
    return F.when(known, F.when(x <= 0, F.lit(1.0)).when(x == float("inf"), F.lit(0.0))
                  .when(t < a + 1.0, below).otherwise(above))
