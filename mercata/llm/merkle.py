"""Merkle manifest of a dataset: an append log of tree nodes in postorder.

A tree of eight children a node stands over each group's leaves, and a like
tree over the groups' roots. Nodes are logged in the order in which they
complete (postorder): a node follows its last child at once, and the nodes on
the right edge that stay short are closed at the end, lowest first. So a
node's place follows from the sizes of the full subtrees before it: when the
leaves before it number ``m``, ``m + m//8 + m//64 + ...`` nodes stand before
it (:func:`log_position`).

Builders are aligned: a task takes ``SPAN`` = 8**4 consecutive leaves of one
group, writes their nodes as one segment of the log, and hands its top to the
next tier, which again works in segments of 8**4. A proof takes its siblings
out of a segment by their closed-form places, tier by tier from the top, so
that every row carries its siblings only within its own task. A hot group is
many segments; nothing but a number of tiers reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mercata.llm.streams import emit, number_rows, rows
from mercata.session import write_table

ARITY = 8
TIER = 4  # levels of a segment
SPAN = ARITY ** TIER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """A row's leaf: lowercase hex SHA-256 over its fields."""
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


# ---------------------------------------------------------------- places in the log

def height(n: int) -> int:
    """Levels above the leaves: 0 for one leaf."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def log_position(level: int, index: int, n: int, levels: int | None = None) -> int:
    """Place of a node in the postorder log of ``n`` leaves (``levels``: the height, or a segment's)."""
    levels = height(n) if levels is None else levels
    last = (index + 1) * ARITY ** level  # leaves up to the end of the node's subtree
    if last <= n:
        return sum((last - 1) // ARITY ** j for j in range(levels + 1)) + level
    full = sum(n // ARITY ** j for j in range(levels + 1))
    return full + sum(n % ARITY ** j != 0 for j in range(1, level))


def log_length(n: int, levels: int) -> int:
    return sum(-(-n // ARITY ** j) for j in range(levels + 1))


def _levels(n: int, tier: int) -> int:
    """Levels that a segment of ``tier`` adds, in a tree of ``n`` leaves."""
    return min(TIER, height(n) - TIER * tier)


def build_segment(digests: list[str], levels: int) -> str:
    """The nodes over ``digests``, in completion order, 64 hex digits each."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(level: int, digest: str) -> None:
        log.append(digest)
        if level < levels:
            open_[level].append(digest)
            if len(open_[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        add(level + 1, _hash("".join(run)))

    for d in digests:
        add(0, d)
    for level in range(levels):  # the right edge
        if open_[level]:
            close(level)
    return "".join(log)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- build

_SEGMENT = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("n_segment", pa.int64()), ("n", pa.int64()),
                      ("nodes", pa.string()), ("digest", pa.string())])


def _builder(tier: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            for (tree, segment), group in groupby(rows(batches), key=lambda r: r[:2]):
                _, _, _, _, n = next(group)  # the marker: leaves of the whole tree
                digests = [r[3] for r in group]
                nodes = build_segment(digests, _levels(n, tier))
                yield tree, segment, len(digests), n, nodes, nodes[-64:]
        yield from emit(segments(), _SEGMENT)
    return run


def _tier(leaves: DataFrame, tier: int) -> DataFrame:
    """Segments over (tree, at, digest, n: null at tier 0, where the rows are counted here)."""
    placed = leaves.select("tree", F.floor(F.col("at") / SPAN).alias("segment"), "at", "digest", "n")
    marks = placed.groupBy("tree", "segment").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    if tier == 0:
        total = marks.groupBy("tree").agg(F.sum("c").alias("total"))
        marks = marks.join(total.withColumnRenamed("tree", "_t").hint("merge"), F.col("tree") == F.col("_t")).withColumn("n", F.col("total"))
    marks = marks.select("tree", "segment", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"), "n")
    dealt = (placed.unionByName(marks).repartition("tree", "segment").sortWithinPartitions("tree", "segment", "at")
             .select("tree", "segment", "at", "digest", "n"))
    return write_table(dealt.mapInArrow(_builder(tier), "tree string, segment long, n_segment long, n long, nodes string, digest string"),
                       f"merkle-log-{tier}")


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The log's segments, one written table a tier, over leaves (tree, at, digest).

    ``nodes`` holds a segment's nodes in completion order, ``digest`` its top,
    ``n`` the leaves of the whole tree. Trees of one segment end at tier 0.
    """
    tiers, base = [], leaves.select("tree", "at", "digest", F.lit(None).cast("long").alias("n"))
    while True:
        tiers.append(_tier(base, len(tiers)))
        size = SPAN ** len(tiers)
        # A tree goes on while more than one segment of this tier stands over it.
        going = tiers[-1].filter(F.col("n") > size)
        if going.isEmpty():
            return tiers
        base = going.select("tree", F.col("segment").alias("at"), "digest", "n")


def log_entries(tiers: list[DataFrame]) -> DataFrame:
    """(tree, position, level, index, digest): every node of the log once, at its place in its tree's log."""
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int64()), ("index", pa.int64()), ("digest", pa.string())])

    def lister(tier: int):
        def run(batches):
            def entries():
                for tree, segment, m, n, nodes in rows(batches):
                    levels = _levels(n, tier)
                    for level in range(1 if tier else 0, levels + 1):
                        for i in range(-(-m // ARITY ** level)):
                            at = log_position(level, i, m, levels)
                            index = segment * ARITY ** (TIER - level) + i if levels == TIER else i
                            up = level + TIER * tier
                            yield tree, log_position(up, index, n), up, index, nodes[64 * at: 64 * at + 64]
            yield from emit(entries(), schema)
        return run

    out = None
    for k, t in enumerate(tiers):
        e = t.select("tree", "segment", "n_segment", "n", "nodes").mapInArrow(
            lister(k), "tree string, position long, level long, index long, digest string")
        out = e if out is None else out.unionByName(e)
    return out


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest, n): each tree's root."""
    out = None
    for k, t in enumerate(tiers):
        top = t.filter(F.col("n") <= SPAN ** (k + 1)).select("tree", "digest", "n")
        out = top if out is None else out.unionByName(top)
    return out


# ---------------------------------------------------------------- proofs

def _paths(segment: str, m: int, levels: int, above: list[str]):
    """A function from a segment's leaf to its path [left, right, left, right, ...] up to the root."""
    known: dict[tuple[int, int], list[str]] = {}

    def path(level: int, i: int) -> list[str]:
        if level == levels:
            return above
        found = known.get((level, i))
        if found is None:
            first = i - i % ARITY
            run = [segment[64 * p: 64 * p + 64] for p in (
                log_position(level, j, m, levels) for j in range(first, min(first + ARITY, -(-m // ARITY ** level))))]
            found = ["".join(run[: i - first]), "".join(run[i - first + 1:]), *path(level + 1, i // ARITY)]
            if level:
                known[level, i] = found
        return found
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = _hash(left + leaf + right)
    return leaf


def _prover(tier: int, schema: pa.Schema, found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs():
            for _, group in groupby(rows(batches), key=lambda r: r[:2]):
                _, _, _, nodes, m, n, above, roots_, *_ = next(group)
                path = _paths(nodes, m, _levels(n, tier), above)
                for r in group:
                    yield found(r, path(0, r[2] % SPAN), roots_)
        yield from emit(proofs(), schema)
    return run


def _prove(base: DataFrame, segments: DataFrame, above: DataFrame, tier: int, columns: list[str], schema: pa.Schema, ddl: str,
           found) -> DataFrame:
    """Apply ``found`` to the rows (tree, at, columns) with their paths.

    ``above``: (tree, segment, path, roots) of each segment's top. One segment
    row and one path row go ahead of a segment's rows in its task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    # Paths and segments are long for their compressed files' size: a merge join at any size.
    head = segments.join(above.withColumnsRenamed({"tree": "_t", "segment": "_s"}).hint("merge"),
                         (F.col("tree") == F.col("_t")) & (F.col("segment") == F.col("_s")))
    head = head.select("tree", "segment", F.lit(-1).cast("long").alias("at"), "nodes", "n_segment", "n", "path", "roots",
                       *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    body = base.select("tree", F.floor(F.col("at") / SPAN).alias("segment"), "at", F.lit(None).cast("string").alias("nodes"),
                       F.lit(None).cast("long").alias("n_segment"), F.lit(None).cast("long").alias("n"),
                       F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("array<string>").alias("roots"), *columns)
    dealt = head.unionByName(body).repartition("tree", "segment").sortWithinPartitions("tree", "segment", "at")
    return dealt.mapInArrow(_prover(tier, schema, found), ddl)


_PATH = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("path", pa.list_(pa.string())), ("roots", pa.list_(pa.string()))])
_PATH_DDL = "tree string, segment long, path array<string>, roots array<string>"


def prove(base: DataFrame, tiers: list[DataFrame], above: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, found) -> DataFrame:
    """``found(row, path, roots)`` for each row (tree, at, *columns; row[8:] are the columns).

    ``above``: (tree, path, roots), the way on from each tree's root.
    """
    ways = None
    for k in range(len(tiers) - 1, -1, -1):
        t = tiers[k]
        # Tops of trees that end here go on at their tree's way; others at their place in the tier above.
        ends = t.filter(F.col("n") <= SPAN ** (k + 1)).select(F.col("tree").alias("_r"))
        way = above.join(ends.hint("merge"), F.col("tree") == F.col("_r")).select("tree", F.lit(0).cast("long").alias("segment"), "path", "roots")
        if ways is not None:
            way = way.unionByName(ways)
        if k == 0:
            return _prove(base, t, way, 0, columns, schema, ddl, found)
        lower = tiers[k - 1].filter(F.col("n") > SPAN ** k).select("tree", F.col("segment").alias("at"))
        ways = write_table(_prove(lower, t, way, k, [], _PATH, _PATH_DDL, lambda r, p, up: (r[0], r[2], p, up)), f"merkle-paths-{k}")


# ---------------------------------------------------------------- the manifest of a table

def group_key(group: Column) -> Column:
    """The group as a tree's name whose bytewise order puts null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(df: DataFrame, key: str, group: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, roots, siblings and recomputed root of every row of ``df``.

    ``fields`` enter a leaf in their order. A group's leaves ascend by ``key``
    (nulls first, equal keys by digest); groups follow one another in byte
    order, null first. ``tampered`` maps fields to the expressions that stand
    in for them when the root is recomputed. Returns (key, group, leaf,
    subroot, root, siblings: left to right, level by level, folded_root,
    verified).

    Null fields count as ``-``, so null and empty differ; a text of any length
    is hashed whole, in the scan. Repeated rows are leaves of their own. An
    empty table gives no rows. Only the named columns are read, so other
    columns may have any name.
    """
    stand_in = tampered or {}
    leaves = write_table(df.select(
        group_key(F.col(group)).alias("tree"), F.col(key).alias("key"), F.col(group).alias("group"),
        leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        leaf_digest(*[stand_in.get(f, F.col(f)) for f in fields]).alias("tampered")), "merkle-leaves")
    base = number_rows(leaves, ["tree"], ["key", "digest"], "merkle-places")
    tiers = append_log(base)
    subroots = write_table(roots(tiers), "merkle-subroots")
    # The tree over the groups: its leaves are the subroots in the groups' order.
    top = number_rows(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["tree"], ["name"], "merkle-top")
    top_tiers = append_log(top)
    root = roots(top_tiers).select("tree", F.array().cast("array<string>").alias("path"), F.array("digest").alias("roots"))
    way_schema = pa.schema([("tree", pa.string()), ("path", pa.list_(pa.string())), ("roots", pa.list_(pa.string()))])
    above = write_table(prove(top, top_tiers, root, ["name", "digest"], way_schema, "tree string, path array<string>, roots array<string>",
                              lambda r, p, up: (r[8], p, [r[9], *up])), "merkle-tops")

    kinds = {f.name: f.dataType for f in base.schema.fields}
    out = pa.schema([("key", to_arrow_type(kinds["key"])), ("group", to_arrow_type(kinds["group"])), ("leaf", pa.string()), ("subroot", pa.string()),
                     ("root", pa.string()), ("siblings", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def found(r, path, up):
        folded = fold(r[11], path)
        return r[8], r[9], r[10], up[0], up[1], "".join(path), folded, folded == up[1]

    ddl = (f"key {kinds['key'].simpleString()}, group {kinds['group'].simpleString()}, leaf string, subroot string, root string, "
           "siblings string, folded_root string, verified boolean")
    return prove(base, tiers, above, ["key", "group", "digest", "tampered"], out, ddl, found).withColumnsRenamed({"key": key, "group": group})
