"""Embedding near-duplicates by NN-descent.

Equal vectors form one class. Every class gets a neighbour list, first from
blocks of classes that are adjacent in the Gray order of random sign codes,
then refined: a vertex joins its neighbours (both directions) with each other,
and pairs closer than a list's last entry enter that list. Rounds go on until
hardly any pair at or above the threshold is new.

A list that is full of links is saturated. A full list can only hide links
between two saturated vertices, so those of different components are compared
with each other, in tight pieces that the angle between their centres mostly
rules out. Then links never leave a component, and components that hold a
saturated list are compared whole, block against block, which enlarges those
lists as far as they can reach; only counts leave a task.

An audit compares a bounded query set with all vectors in blocks and counts
which of all their links are found so; below the target recall, lists double and
refinement goes on. If that does not help, all vectors are compared in pieces.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.graph import connected_components
from mercata.session import write_table

LIST = 8
TABLES, CODE_BITS, BLOCK = 6, 16, 64
ROUNDS, WIDENINGS = 8, 3
#: Refinement stops once a round adds less than this share of links.
SETTLED = 0.002
#: Vectors in the audit (chosen by hash) and the recall it asks for.
AUDIT, RECALL = 1024, 0.97
#: Vectors per block of a component that is compared whole.
PIECE = 512
#: Cosine to the first vector in a piece compared across components; centres of such pieces per block.
TIGHT, CENTRES = 0.95, 1024


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)[:, None]  # no overflow or underflow in the norm
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _pairs(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "sim"])


def _seed_lists(classes: DataFrame, d: int, size: int, shift: int) -> DataFrame:
    """Pairs (a, b, sim): each class's closest ones in its block of each table."""
    planes = np.random.default_rng(20_240 + shift).normal(size=(d, TABLES * CODE_BITS))

    def deal(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            bits = (_matrix(vectors, d) @ planes > 0).reshape(-1, TABLES, CODE_BITS)
            rank = np.cumsum(bits, axis=2) % 2  # Gray rank: running parity from the top bit
            rank = rank @ (1 << np.arange(CODE_BITS - 1, -1, -1))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rank), t, np.int32)), pa.array(rank[:, t].astype(np.int32)), ids, vectors],
                    ["tab", "rank", "id", "vec"])

    dealt = classes.select("id", "vec").mapInArrow(deal, "tab int, rank int, id long, vec array<float>")
    dealt = dealt.repartitionByRange("tab", "rank", "id").sortWithinPartitions("tab", "rank", "id").select("id", "vec")

    def near(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), d)
                s = x @ x.T
                s[ids[:, None] == ids[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :size]
                a = np.repeat(np.arange(len(ids)), top.shape[1])
                b = top.ravel()
                real = s[a, b] > -2
                yield _pairs(ids[a[real]], ids[b[real]], s[a[real], b[real]])

    return dealt.mapInArrow(near, "a long, b long, sim double")


def _best(pairs: DataFrame, size: int) -> DataFrame:
    """The ``size`` closest of each list; a pair found again is not new."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")


def _refine(lists: DataFrame, classes: DataFrame, d: int, size: int) -> DataFrame:
    """One round: neighbours of a vertex meet; returns pairs better than a list's last entry."""
    last = lists.groupBy(F.col("a").alias("id")).agg(
        F.when(F.count("*") >= size, F.min("sim")).otherwise(F.lit(-2.0)).alias("last"))
    nodes = classes.select("id", "vec").join(last, "id")
    around = lists.select(F.col("a").alias("v"), F.col("b").alias("id"), "new").unionByName(
        lists.select(F.col("b").alias("v"), F.col("a").alias("id"), "new"))
    around = around.groupBy("v", "id").agg(F.max("new").alias("new"))
    fresh = around.filter("new").select("v").distinct()
    members = around.join(fresh, "v", "left_semi").join(nodes, "id").select("v", "id", "new", "last", "vec")
    members = members.repartition("v").sortWithinPartitions("v")

    def meet(batches):
        held = None

        def local(part: pa.RecordBatch):
            v = part.column(0).to_numpy()
            ids, last = part.column(1).to_numpy(), part.column(3).to_numpy()
            new, x = part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(4), d)
            cuts = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
            found = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                for at in range(s, e, 1024):  # a hub's neighbours meet in strips
                    i = slice(at, min(at + 1024, e))
                    sims = x[i] @ x[s:e].T
                    better = (sims > last[i][:, None]) & (new[i][:, None] | new[s:e][None, :]) & (ids[i][:, None] != ids[s:e][None, :])
                    p, q = np.nonzero(better)
                    found.append((ids[i][p], ids[s:e][q], sims[p, q]))
            if found:
                yield _pairs(*(np.concatenate(c) for c in zip(*found)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            v = batch.column(0).to_numpy()
            keep = int(np.searchsorted(v, v[-1]))  # the last group may go on
            held = batch.slice(keep)
            if keep:
                yield from local(batch.slice(0, keep))
        if held is not None and held.num_rows:
            yield from local(held)

    return members.mapInArrow(meet, "a long, b long, sim double")


def _bridges(members: DataFrame, d: int, threshold: float) -> DataFrame:
    """Edges (a, b) of roots that connect all components with links between ``members`` (root, id, vec).

    Members form pieces of one component around their first vector. Pieces are
    compared if their centres' angle less both radii is within the threshold's.
    """
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            root, x = batch.column(0).to_numpy(), _matrix(batch.column(2), d)
            cuts = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
            order, radius = [], []
            for s, e in zip(cuts, np.append(cuts[1:], len(root))):
                for at in range(s, e, PIECE):
                    rest = np.arange(at, min(at + PIECE, e))
                    while len(rest):
                        near = x[rest] @ x[rest[0]]
                        inside = near >= TIGHT
                        inside[0] = True
                        order.append(rest[inside])
                        radius.append(np.arccos(np.clip(near[inside][1:].min(initial=1.0), -1.0, 1.0)))
                        rest = rest[~inside]
            at = pa.array(np.cumsum([0, *map(len, order)]), pa.int32())
            first, all_ = np.array([o[0] for o in order]), pa.array(np.concatenate(order))
            ids, vectors = batch.column(1), batch.column(2).take(all_).flatten()
            yield pa.RecordBatch.from_arrays(
                [pa.array(root[first]), ids.take(pa.array(first)), pa.array(radius, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(at.to_numpy() * d, pa.int32()), vectors)],
                ["root", "piece", "radius", "vecs"])

    pieces = write_table(members.repartitionByRange("root", "id").sortWithinPartitions("root", "id").select("root", "id", "vec")
                         .mapInArrow(cut, "root long, piece long, radius double, vecs array<float>"), "nn-tight")

    def gather(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CENTRES):
                part = batch.slice(at, CENTRES)
                row = [pa.array([part.column(0)[0].as_py()], pa.int64())]
                for c in part.columns[:3]:
                    row.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
                flat = part.column(3).flatten()
                row.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(row, ["block", "pieces", "roots", "radii", "centres"])

    parts = ["pieces", "roots", "radii", "centres"]
    blocks = write_table(pieces.select("piece", "root", "radius", F.slice("vecs", 1, d).alias("centre")).mapInArrow(
        gather, "block long, pieces array<long>, roots array<long>, radii array<double>, centres array<float>"), "nn-centres")
    names = blocks.select("block")
    met = write_table(names.crossJoin(names.withColumnRenamed("block", "block2")).filter("block <= block2"), "nn-centre-pairs")
    other = blocks.select(F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in parts])
    met = met.join(blocks, "block").join(other, "block2").select("block", *parts, "block2", *[f"{c}2" for c in parts])

    def reach(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                (n, p, r, w, x), (m, q, t, u, y) = ((c[0].as_py(), *(c[k].values.to_numpy() for k in (1, 2, 3)), _matrix(c[4].values, d))
                                                    for c in (row[:5], row[5:]))
                near = np.arccos(np.clip(x @ y.T, -1.0, 1.0)) <= w[:, None] + u[None, :] + limit
                near &= r[:, None] != t[None, :]
                i, j = np.nonzero(np.triu(near) if n == m else near)
                yield pa.RecordBatch.from_arrays([pa.array(p[i]), pa.array(q[j])], ["piece", "piece2"])

    pairs = write_table(met.mapInArrow(reach, "piece long, piece2 long"), "nn-tight-pairs")
    own = pieces.select("piece", "root", "vecs")
    whole = (pairs.join(own, "piece").join(own.select(F.col("piece").alias("piece2"), F.col("root").alias("root2"), F.col("vecs").alias("vecs2")),
                                           "piece2").select("root", "vecs", "root2", "vecs2"))

    def compare(batches):
        for batch in batches:
            linked = np.array([(_matrix(x.values, d) @ _matrix(y.values, d).T >= threshold).any()
                               for x, y in zip(batch.column(1), batch.column(3))], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(linked))

    return write_table(whole.mapInArrow(compare, "a long, b long").distinct(), "nn-bridges")


def _audit(edges: DataFrame, groups: DataFrame, dense: DataFrame, classes: DataFrame, d: int, threshold: float, n: int) -> float:
    """Share of all links of a bounded query set that are edges or lie in a component that is compared whole."""
    chosen = classes.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // AUDIT))) == 0).select("id", "vec")
    rows = chosen.limit(2 * AUDIT).collect()  # the modulus already bounds it
    if not rows:
        return 1.0
    names = np.array([r[0] for r in rows], np.int64)
    queries = _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float32())), d)

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            s = queries @ _matrix(batch.column(1), d).T
            q, b = np.nonzero((s >= threshold) & (names[:, None] != ids[None, :]))
            yield _pairs(names[q], ids[b], s[q, b])

    true = classes.select("id", "vec").mapInArrow(scan, "a long, b long, sim double").select("a", "b")
    whole = groups.join(dense, "root", "left_semi")
    hit = (true.join(edges.withColumn("hit", F.lit(True)), ["a", "b"], "left")
           .join(whole.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left")
           .join(whole.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left"))
    t = hit.agg(F.count("*"), F.count_if(F.coalesce("hit", F.col("ra") == F.col("rb"), F.lit(False)))).first()
    return 1.0 if not t[0] else t[1] / t[0]


def _joined(groups: DataFrame, members: DataFrame, classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """``groups`` (id, root) after joining the components that have links between ``members`` (id)."""
    bridges = _bridges(groups.join(members, "id", "left_semi").join(classes.select("id", "vec"), "id").select("root", "id", "vec"), d, threshold)
    if bridges.isEmpty():
        return groups
    up = connected_components(bridges).select(F.col("v").alias("root"), F.col("root").alias("up"))
    return write_table(groups.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "nn-groups")


def neighbour_graph(classes: DataFrame, d: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(edges (a, b), both ways; components (id, root); roots to compare whole (root); audited recall) of ``classes`` (id, vec)."""
    n, size = classes.count(), LIST
    lists = write_table(_best(_seed_lists(classes, d, size, 0).withColumn("new", F.lit(True)), size), "nn-lists")
    for widening in range(WIDENINGS + 1):
        for _ in range(ROUNDS):
            fresh = _refine(lists, classes, d, size).withColumn("new", F.lit(True))
            lists = write_table(_best(lists.withColumn("new", F.lit(False)).unionByName(fresh), size), "nn-lists")
            links, added = lists.agg(F.count_if(F.col("sim") >= threshold),
                                     F.count_if((F.col("sim") >= threshold) & F.col("new"))).first()
            if added <= SETTLED * links:
                break
        close = lists.filter(F.col("sim") >= threshold)
        edges = write_table(close.select("a", "b").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "nn-edges")
        groups = write_table(classes.select("id").join(connected_components(edges).withColumnRenamed("v", "id"), "id", "left")
                             .select("id", F.coalesce("root", "id").alias("root")), "nn-groups")
        full = write_table(close.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= size).select(F.col("a").alias("id")), "nn-full")
        groups = _joined(groups, full, classes, d, threshold)
        dense = write_table(groups.join(full, "id", "left_semi").select("root").distinct(), "nn-dense")
        recall = _audit(edges, groups, dense, classes, d, threshold, n)
        if recall >= RECALL:
            return edges, groups, dense, recall
        if widening < WIDENINGS:
            size *= 2
            lists = write_table(_best(lists.select("a", "b", "sim").withColumn("new", F.lit(True)).unionByName(
                _seed_lists(classes, d, size, widening + 1).withColumn("new", F.lit(True))), size), "nn-lists")
    groups = _joined(groups, classes.select("id"), classes, d, threshold)
    return edges, groups, write_table(groups.select("root").distinct(), "nn-dense"), 1.0


def _count_whole(members: DataFrame, d: int, threshold: float) -> DataFrame:
    """(id, links): links of every vector inside its component, compared block against block."""
    schema = "root long, piece long, ids array<long>, copies array<long>, vecs array<float>"

    def pieces(batches):
        for batch in batches:
            root = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
            cuts = [c for s, e in zip(cuts, np.append(cuts[1:], len(root))) for c in range(s, e, PIECE)]
            for s, e in zip(cuts, [*cuts[1:], len(root)]):
                part = batch.slice(s, e - s)
                row = [pa.array([root[s]], pa.int64()), pa.array([part.column(1)[0].as_py()], pa.int64())]
                for c, t in ((1, pa.int64()), (2, pa.int64())):
                    row.append(pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), part.column(c).cast(t)))
                flat = part.column(3).flatten()
                row.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(row, ["root", "piece", "ids", "copies", "vecs"])

    # Even ranges, whatever a component's size; a piece is named by its first member.
    blocks = write_table(members.repartitionByRange("root", "id").sortWithinPartitions("root", "id")
                         .select("root", "id", "copies", "vec").mapInArrow(pieces, schema), "nn-pieces")
    names = blocks.select("root", "piece")
    pairs = write_table(names.join(names.withColumnRenamed("piece", "piece2"), "root").filter("piece <= piece2")
                        .select("piece", "piece2"), "nn-piece-pairs")
    whole = (pairs.join(blocks.select("piece", "ids", "copies", "vecs"), "piece")
             .join(blocks.select(F.col("piece").alias("piece2"), *[F.col(c).alias(f"{c}2") for c in ("ids", "copies", "vecs")]), "piece2")
             .select("ids", "copies", "vecs", "ids2", "copies2", "vecs2"))

    def compare(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                (i, m, x), (j, k, y) = ((r[0].values.to_numpy(), r[1].values.to_numpy(), _matrix(r[2].values, d))
                                        for r in (row[:3], row[3:]))
                s = (x @ y.T >= threshold).astype(np.int64)
                same = i[0] == j[0]
                if same:
                    np.fill_diagonal(s, 0)
                ids, links = (i, s @ k) if same else (np.concatenate([i, j]), np.concatenate([s @ k, s.T @ m]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["id", "links"])

    return whole.mapInArrow(compare, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) per input row.

    Links: other rows with cosine >= ``threshold`` in double precision.
    Component: the smallest key reachable over links, itself included; kept: the
    key is the component's own. Vectors that are null, zero, hold null or
    non-finite components or are not of the commonest length link with nothing,
    equal ones neither. Null keys are never kept.
    """
    v = F.col("vec")
    sound = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = write_table(df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec"))
                       .withColumn("sound", sound), "nn-rows")
    common = rows.filter("sound").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"),
                           F.col("key").cast("long").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    d = common[0]
    linked = F.col("sound") & (F.size("vec") == d)
    whole = write_table(rows.filter(linked).groupBy("vec").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
                        .withColumn("id", F.monotonically_increasing_id()), "nn-classes")
    edges, groups, dense, _ = neighbour_graph(whole, d, threshold)
    roots = write_table(whole.select("id", "least", "copies").join(groups, "id"), "nn-roots")
    in_dense = roots.join(dense, "root", "left_semi")
    exact = _count_whole(in_dense.join(whole.select("id", "vec"), "id").select("root", "id", "copies", "vec"), d, threshold)
    listed = (edges.join(roots.select(F.col("id").alias("b"), "copies", "root"), "b").join(dense, "root", "left_anti")
              .groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("links")))
    counted = write_table(exact.unionByName(listed), "nn-links")
    ids = write_table(roots.groupBy("root").agg(F.min("least").alias("component_id")), "nn-ids")
    named = write_table(roots.join(ids, "root").join(counted, "id", "left").join(whole.select("id", "vec"), "id")
                        .select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "nn-named")
    found = rows.filter(linked).join(named, "vec").select("key", "n_links", "component_id")
    alone = rows.filter(~linked).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
