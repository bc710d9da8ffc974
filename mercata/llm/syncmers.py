"""Document fingerprints from closed syncmers.

A k-mer (k code points) is a closed syncmer if the smallest of its hashed
s-mers is the first or the last one. That depends on the k-mer alone, so equal
passages give equal anchors wherever they stand, and every stretch of k - s
k-mers holds one. A fingerprint keeps the anchors with the smallest hashes and
their positions; two fingerprints are compared by the anchors they share on
one diagonal (at a common shift of position).
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.llm.text import mix

K, S = 14, 6
#: Anchors kept by a fingerprint.
KEPT = 64
#: Shifts of position that count as one diagonal: an edit of a few words moves the rest a little.
BAND = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of keys dealt to tasks; rows of a range stream through one task in order.
RANGE_ROWS, MOST_RANGES = 1000, 100_000


def _windows_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its last code point) of each closed syncmer.

    The text is led in by k - 1 blanks that no text contains, so that short
    texts and text starts have anchors too; where none qualifies the k-mer with
    the smallest inner hash stands in. An empty text has none.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros(n + k - 1, np.uint64)
    x[k - 1 :] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x[k - 1 :] += np.uint64(1)
    h = x[: len(x) - s + 1].copy()
    for i in range(1, s):
        h *= _BASE
        h += x[i : len(x) - s + 1 + i]
    h = mix(h)
    low = _windows_min(h, k - s + 1)
    at = np.flatnonzero((low == h[: len(low)]) | (low == h[k - s :]))
    if not len(at):
        at = np.array([int(low.argmin())])
    out = x[at]
    for i in range(1, k):
        out = out * _BASE + x[at + i]
    return mix(out), at


def fingerprint(text: str | None, kept: int = KEPT) -> str:
    """The ``kept`` smallest 32-bit anchors with their first positions: 'hash:position' in hex, ascending, joined by '.'.

    Null and empty texts give ''. Equal texts give equal fingerprints.
    """
    hashes, at = closed_syncmers(text or "")
    low, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return ".".join(f"{h:08x}:{p:x}" for h, p in zip(low[:kept].tolist(), at[first[:kept]].tolist()))


def _parse(f: str) -> dict[int, int]:
    return {int(a[:8], 16): int(a[9:], 16) for a in f.split(".")} if f else {}


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """Share of text two fingerprints have in common, 0 to 1 (equal fingerprints: 1).

    The smallest anchors of the union are a fair sample of it; those in both
    and on the most common diagonal estimate the Jaccard index j, and 2j/(1+j)
    is the share of anchors in common.
    """
    if a == b:
        return 1.0
    x, y = _parse(a), _parse(b)
    union = sorted(x.keys() | y.keys())
    if len(x) == kept or len(y) == kept:
        union = union[:kept]
    shifts = np.sort(np.array([x[h] - y[h] for h in union if h in x and h in y], np.int64))
    if not len(shifts):
        return 0.0
    on = int((np.searchsorted(shifts, shifts + BAND, "right") - np.arange(len(shifts))).max())
    return 2.0 * on / (len(union) + on)


def fingerprints(df: DataFrame, key: str, text: str, kept: int = KEPT) -> DataFrame:
    """(key, fingerprint) per input row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = pa.array([fingerprint(t, kept) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["key", "fingerprint"])

    return (df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, fingerprint string")
            .withColumnRenamed("key", key))


#: Columns that ``compare_with_edit`` adds, and their SQL types.
EDIT_COLUMNS = [("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"),
                ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
                ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]


def compare_with_edit(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprint of each text against an edited text's and the next document's: ``key`` and EDIT_COLUMNS.

    The next document is the next row by descending integer key; after the last
    comes the first again. Null keys stand after all others, rows of one key in
    the order of their texts; null texts are empty. The edit replaces the last
    floor(n/2) code points by the first as many of the next text.

    Key ranges at quantiles stream through the tasks in order; a range's first
    key also goes to the range before it, so texts are shuffled once.
    """
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"),
                     F.col(key).isNull().alias("none"), F.coalesce(text, F.lit("")).alias("text"))
    keys = rows.select("key")
    ranges = min(MOST_RANGES, max(1, keys.count() // RANGE_ROWS))
    at = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = keys.agg(F.percentile_approx("key", at, max(10_000, 10 * ranges))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))[: None if ranges > 1 else 0]

    def part_of(k: pd.Series) -> np.ndarray:
        return (len(bounds) - np.searchsorted(bounds, k.to_numpy(), "right")).astype(np.int32)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(part_of(k))

    # One row per range comes to the driver: its number and its first (largest) key.
    heads = sorted((r[0], r[1]) for r in keys.groupBy(range_of("key").alias("part")).agg(F.max("key")).collect())
    first = dict(heads)
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        return pd.Series([[p, before[v]] if first[p] == v else [p] for p, v in zip(part_of(k).tolist(), k.tolist())])

    dealt = (rows.select(places("key").alias("places"), "key", "none", "text")
             .select(F.posexplode("places").alias("extra", "part"), "key", "none", "text")
             .repartition("part").sortWithinPartitions("part", "extra", F.desc("key"), "text")
             .select("part", "extra", "key", "none", "text"))
    arrow = pa.schema([(key, pa.int64()), *[(n, t) for n, t, _ in EDIT_COLUMNS]])

    def run(batches):
        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(a, 256).columns))

        out, held = [], None
        for part, extra, k, none, text in pieces():
            own = fingerprint(text)
            if held is not None and held[0] == part:
                _, before_key, before_text, before_own = held
                half = len(before_text) // 2
                edited = before_text[: len(before_text) - half] + text[:half]
                other = fingerprint(edited)
                out.append((before_key, len(before_text), hashlib.sha256(edited.encode()).hexdigest(), before_own, other,
                            likeness(before_own, other), likeness(before_own, own)))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                    out = []
            # The next range's head ends a range; a second row of that head key is not needed.
            held = None if extra else (part, None if none else k, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return dealt.mapInArrow(run, ", ".join([f"`{key}` long", *[f"{n} {t}" for n, _, t in EDIT_COLUMNS]]))
