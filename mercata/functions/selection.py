"""Exact order statistics by radix histograms, without sorting or shuffling values.

A double becomes a 64-bit integer in the same order (:func:`order_code`). Each
pass counts the codes by their next 18 bits, for all columns and all wanted
ranks at once, among the rows whose higher bits lead to a wanted rank; after
four passes, or as soon as a cell holds one value only, the value at a rank is
known. What is shuffled are cells (at most 2**18 a column and open prefix),
never values, so a pass costs a scan and little else however many distinct
values there are. The passes are actions: give them a written table.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 18  # bits a pass; 64 take four passes, and values of 24 significant bits two

# The bits of x = m 2^e, m next to [1, 2): the logarithm may miss by one beside a power of two. Below 2**-1022 the
# bits are a multiple of 2**-1074; infinity has the largest exponent.
_BITS = "({e} + 1023) * {one}L + cast(({m} - 1) * {one}D as bigint)"
_ONE = 1 << 52
_SIZE = f"""case when abs(_x) = 0 then 0L when abs(_x) = double('infinity') then {2047 << 52}L
  when abs(_x) < {2.0 ** -1022!r}D then cast(abs(_x) * {2.0 ** 537!r}D * {2.0 ** 537!r}D as bigint)
  when _m < 1 then {_BITS.format(e="_e - 1", m="_m * 2", one=_ONE)} when _m >= 2 then {_BITS.format(e="_e + 1", m="_m / 2", one=_ONE)}
  else {_BITS.format(e="_e", m="_m", one=_ONE)} end"""


def order_code(df: DataFrame, value: str, keep: Sequence[str] = (), code: str = "code") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``code``: a bigint in the order of the doubles ``value``, which are its bits,
    negated below zero.

    -0.0 counts as 0.0; NULL and NaN (missing, as in pandas) give NULL. The
    steps are projections of their own, so that logarithm and power are
    computed once, and one column at a time keeps the generated code small.
    """
    kept = [f"`{c}`" for c in keep]
    out = df.selectExpr(*kept, f"cast(`{value}` as double) as _x").selectExpr(*kept, "_x", "least(floor(log2(abs(_x))), 1023) as _e")
    out = out.selectExpr(*kept, "_x", "_e", "abs(_x) / pow(2D, cast(_e as double)) as _m")
    # The partition number is never negative: it keeps the optimizer from copying these steps into later filters.
    return out.selectExpr(*kept, f"if(spark_partition_id() >= 0 and _x is not null and not isnan(_x), if(_x < 0, -({_SIZE}), {_SIZE}), null) as `{code}`")


def decode(code: int) -> float:
    """The double of a code."""
    value = struct.unpack(">d", abs(code).to_bytes(8))[0]
    return -value if code < 0 else value


def select_ranks(long: DataFrame, names: Sequence[str], ranks: Sequence[str]) -> dict[str, tuple[int, list[int | None]]]:
    """{name: (rows, [code at each rank])} for rows (f: index of a name, code: bigint, c: weight); NULL codes are left out.

    ``ranks`` are the wanted 0-based ranks, SQL over the number of rows ``{n}``;
    a rank outside the rows has no code. Names without rows are missing. Only
    open prefixes and their counts (at most one a name and rank) come to the
    driver.
    """
    out: dict[str, tuple[int, dict]] = {}
    open_: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by name and prefix: (which rank, rank inside)
    shifts = [*range(64 - DIGIT, 0, -DIGIT), 0]
    for above, shift in zip([64, *shifts], shifts):
        first = above == 64
        here = "code is not null" if first else " or ".join(
            f"(f = {i} and shiftright(code, {above}) in ({', '.join(f'{p}L' for p in held)}))" for i, held in open_.items())
        cells = long.filter(here).selectExpr("f", f"shiftright(code, {shift}) as cell", "code", "c").groupBy("f", "cell").agg(
            F.expr("sum(c) as n"), *([] if first else [F.expr("min(code) as lo"), F.expr("max(code) as hi")]))
        ends = [] if first else ["lo", "hi"]
        parent = "0L" if first else f"shiftright(cell, {above - shift})"
        inside = "over (partition by f, parent"  # at most 2**18 cells
        cells = cells.selectExpr("f", "cell", "n", *ends, f"{parent} as parent").selectExpr(
            "*", f"coalesce(sum(n) {inside} order by cell rows between unbounded preceding and 1 preceding), 0L) as before", f"sum(n) {inside}) as total")
        if first:
            wanted = ", ".join(f"named_struct('k', {k}, 'r', cast({r.replace('{n}', 'total')} as bigint))" for k, r in enumerate(ranks))
            wanted = cells.selectExpr("*", f"inline(array({wanted}))")
        else:
            rows = [(i, p, k, r) for i, prefixes in open_.items() for p, held in prefixes.items() for k, r in held]
            # At most one row a name and rank.
            small = F.broadcast(long.sparkSession.createDataFrame(rows, "_f int, _p long, k int, r long"))
            wanted = cells.join(small, F.expr("f = _f and parent = _p"))
        hits = wanted.filter("r >= before and r < before + n").selectExpr("f", "cell", *ends, "k", "r - before as r", "total").collect()
        if first:
            out = {names[i]: (total, {}) for i, total in {(h["f"], h["total"]) for h in hits}}
        open_ = {}
        for h in hits:
            if not first and h["lo"] == h["hi"]:
                out[names[h["f"]]][1][h["k"]] = h["lo"]
            else:
                open_.setdefault(h["f"], {}).setdefault(h["cell"], []).append((h["k"], h["r"]))
        if not open_:
            break
    return {name: (n, [found.get(k) for k in range(len(ranks))]) for name, (n, found) in out.items()}


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], count: str | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation (pandas / numpy 'linear', DuckDB ``quantile_cont``).

    position = p * (n - 1); result = lo + (hi - lo) * (position - floor). NULL
    and NaN are left out; a column without values gives NULLs. ``count``
    weights rows.
    """
    weight = f"cast(`{count}` as bigint)" if count else "1L"
    fields = ", ".join(f"named_struct('f', {i}, 'x', cast(`{c}` as double))" for i, c in enumerate(columns))
    long = df.selectExpr(f"{weight} as c", f"inline(array({fields}))").filter("x is not null")
    ranks = [f"{step}({float(p)!r}D * cast({{n}} - 1 as double))" for p in probs for step in ("floor", "ceil")]
    found = select_ranks(order_code(long, "x", ["f", "c"]), columns, ranks)
    out = {}
    for c in columns:
        if c not in found:
            out[c] = [None] * len(probs)
            continue
        n, codes = found[c]
        values = []
        for p, a, b in zip(probs, codes[::2], codes[1::2]):
            lo, hi, at = decode(a), decode(b), float(p) * float(n - 1)
            values.append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
        out[c] = values
    return out
