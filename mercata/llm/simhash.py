"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint is one or more 64-bit words. Every word is rotated by 0, 16, 32
and 48 bits; each rotation is a table of fingerprints range-sorted by Gray
rank. Fingerprints whose leading 16 bits agree are neighbours in that order and
form a group. Inside a group, consecutive fingerprints hang under nodes that
hold the bits all of them share (mask and pattern); a parent holds the bits
shared by its children, which then keep only their remaining bits. A search
adds up differences from the top down and drops a whole node as soon as the sum
passes the limit.

Ranges are even however large a group is. Groups cut by a range border or
longer than a chunk are compared chunk against chunk, after the chunks' own
masked patterns have ruled out most pairs. Only spanning edges leave a task.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mercata.llm.graph import connected_components
from mercata.llm.text import mix
from mercata.session import write_table

BLOCK_BITS = 16
FANOUT = 8
CHUNK = 4096
#: Pairs a search holds at a time.
FRONTIER = 1 << 21
_LANES = np.uint64(0x0101010101010101)


# ------------------------------------------------------------ fingerprints

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z lower-cased, repeats included."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    n = len(w) - words + 1
    runs = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64, n)


def simhash(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive stretch of ``sizes`` hashes: bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.int64)
    first = np.cumsum(n) - n
    # Byte lanes hold counts up to 255, so stretches are summed in blocks of 255 hashes.
    blocks = -(-n // 255)
    at = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    block_of = np.cumsum(blocks) - blocks
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_of, axis=0)
        over = counts * 2 > n[:, None]
        bits |= (over.astype(np.uint64) << (np.uint64(8) * np.arange(8, dtype=np.uint64) + np.uint64(j))).sum(1, dtype=np.uint64)
    out[full] = bits
    return out


def fingerprints(df: DataFrame, key: str, text: str, words: int = 3, width: int = 1) -> DataFrame:
    """(key, fp array<long>): ``width`` 64-bit words per row; the first votes with the shingles' XXH64 itself.

    Texts without a word (null, empty, white space only) get all zeros.
    """
    kind = df.schema[key].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in hashes], np.int64)
            fps = np.empty((len(sizes), width), np.uint64)
            done = 0
            while done < len(sizes):  # a bounded number of hashes at a time, one text at least
                stop = max(done + 1, done + int(np.searchsorted(np.cumsum(sizes[done:]), FRONTIER)))
                h = np.concatenate(hashes[done:stop])
                for j in range(width):
                    seeded = mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if j else h
                    fps[done:stop, j] = simhash(seeded, sizes[done:stop])
                done = stop
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * width, pa.int32()),
                                             pa.array(fps.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(compute, f"key {kind}, fp array<long>")


# ------------------------------------------------------------ the index

class GrayIndex:
    """Hierarchical index over Gray-sorted fingerprints ``x`` (n, words); ``groups``: first item of each group."""

    def __init__(self, x: np.ndarray, groups: np.ndarray):
        self.x, self.levels = x, []
        both, any_ = x, x
        sizes, start = np.diff(np.append(groups, len(x))), groups
        while True:
            nodes = -(-sizes // FANOUT)
            inside = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            first = np.repeat(start, nodes) + FANOUT * inside
            count = np.minimum(np.repeat(sizes, nodes) - FANOUT * inside, FANOUT)
            both = np.bitwise_and.reduceat(both, first, axis=0)
            any_ = np.bitwise_or.reduceat(any_, first, axis=0)
            self.levels.append((~(both ^ any_), both, first, count))  # shared bits, their values, children
            sizes, start = nodes, np.cumsum(nodes) - nodes
            if (nodes <= 1).all():
                break
        self.levels.reverse()

    def links(self, queries: np.ndarray, roots: np.ndarray, most: int):
        """(query number, item) arrays within ``most`` differing bits; query i searches group ``roots[i]`` only."""
        q, node = np.arange(len(queries)), roots
        diff, above = np.zeros(len(q), np.int64), np.zeros((1, queries.shape[1]), np.uint64)
        held = np.zeros(len(q), np.int64)
        for mask, pattern, first, count in self.levels:
            rest = mask[node] & ~above[held]  # bits not yet counted further up
            diff = diff + np.bitwise_count((queries[q] ^ pattern[node]) & rest).sum(1, dtype=np.int64)
            keep = diff <= most
            q, node, diff = q[keep], node[keep], diff[keep]
            above, held = mask, np.repeat(node, count[node])
            n = count[node]
            child = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, diff, node = np.repeat(q, n), np.repeat(diff, n), child
        diff = diff + np.bitwise_count((queries[q] ^ self.x[node]) & ~above[held]).sum(1, dtype=np.int64)
        keep = diff <= most
        return q[keep], node[keep]


class Forest:
    """Union-find over 0..n-1, merged by arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.up[a], self.up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while (flat := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = flat

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.flatnonzero(self.up != np.arange(len(self.up)))
        return self.up[low], low


def _inside(x: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of all links inside groups of Gray-sorted ``x``."""
    sizes = np.diff(np.append(groups, len(x)))
    index, forest = GrayIndex(x, groups), Forest(len(x))
    cost = np.cumsum(np.repeat(sizes, sizes))
    roots = np.repeat(np.arange(len(groups)), sizes)
    a, limit = 0, max(1, FRONTIER // x.shape[1])
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + limit)))
        q, item = index.links(x[a:b], roots[a:b], most)
        later = item > q + a
        forest.join(q[later] + a, item[later])
        a = b
    return forest.edges()


def _between(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links from ``x`` to ``y`` (numbered after x)."""
    index, forest = GrayIndex(y, np.zeros(1, np.int64)), Forest(len(x) + len(y))
    step = max(1, FRONTIER // x.shape[1] // len(y))
    for a in range(0, len(x), step):
        q, item = index.links(x[a : a + step], np.zeros(len(x[a : a + step]), np.int64), most)
        forest.join(q + a, item + len(x))
    return forest.edges()


# ------------------------------------------------------------ links and components

def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the order of the binary-reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


_CUT = ("kind string, a long, b long, tab int, lead long, chunk long, mask array<long>, pattern array<long>, "
        "ids array<long>, fps array<long>")


def vertex(fp: Column, width: int) -> Column:
    return fp[0] if width == 1 else F.xxhash64(fp)


def link_edges(classes: DataFrame, width: int, most: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``classes`` (v, fp; distinct) linked at ``most`` bits.

    With one word and at most 3 bits every link is found: of four blocks at
    least one agrees. With several words a pair meets if any 16-bit block of
    any word agrees.
    """
    def deal(batches):
        """Each fingerprint once per word and rotation: table, leading bits of the Gray rank, the rest of it."""
        for batch in batches:
            v, fps = batch.column(0), batch.column(1)
            x = fps.flatten().to_numpy().view(np.uint64).reshape(-1, width)
            for tab in range(4 * width):
                word, by = x[:, tab // 4], np.uint64(BLOCK_BITS * (tab % 4))
                rank = _gray_rank((word << by) | (word >> (np.uint64(64) - by)) if by else word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tab, np.int32)),
                     pa.array((rank >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)),
                     pa.array((rank & np.uint64((1 << 64 - BLOCK_BITS) - 1)).astype(np.int64)), v, fps],
                    ["tab", "lead", "rest", "v", "fp"])

    dealt = classes.select("v", "fp").mapInArrow(deal, "tab int, lead long, rest long, v long, fp array<long>")
    dealt = dealt.repartitionByRange("tab", "lead", "rest").sortWithinPartitions("tab", "lead", "rest")

    def cut(batches):
        seq, held = TaskContext.get().partitionId() << 32, None

        def flush(part, open_left, open_right):
            """Links inside the part's groups; chunks of groups that reach further."""
            nonlocal seq
            tab, lead, v, x = part
            starts = np.flatnonzero(np.append(True, (tab[1:] != tab[:-1]) | (lead[1:] != lead[:-1])))
            ends = np.append(starts[1:], len(tab))
            pieces, reach = [], []
            for g in np.flatnonzero(ends - starts > CHUNK):
                reach.extend((s, min(s + CHUNK, ends[g])) for s in range(starts[g], ends[g], CHUNK))
                pieces.extend(range(starts[g] + CHUNK, ends[g], CHUNK))
            if open_left and ends[0] - starts[0] <= CHUNK:
                reach.append((starts[0], ends[0]))
            if open_right and (len(starts) > 1 or not open_left) and ends[-1] - starts[-1] <= CHUNK:
                reach.append((starts[-1], ends[-1]))
            groups = np.union1d(starts, np.array(pieces, np.int64)).astype(np.int64)
            up, low = _inside(x, groups, most)
            n = len(up)
            if n:
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["edge"] * n), pa.array(v[up]), pa.array(v[low]), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), none, none, none, none], names)
            for s, e in reach:
                both, any_ = np.bitwise_and.reduce(x[s:e]), np.bitwise_or.reduce(x[s:e])
                lists = [pa.array([a.view(np.int64).tolist()], pa.list_(pa.int64()))
                         for a in (~(both ^ any_), both, v[s:e], x[s:e].reshape(-1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["chunk"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tab[s]], pa.int32()),
                     pa.array([lead[s]], pa.int64()), pa.array([seq], pa.int64()), *lists], names)
                seq += 1

        names = [f.split()[0] for f in _CUT.split(", ")]
        first = True
        for batch in batches:
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(),
                    batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, width))
            if not batch.num_rows:
                continue
            part = part if held is None else tuple(np.concatenate(p) for p in zip(held, part))
            tab, lead = part[0], part[1]
            last = np.flatnonzero((tab != tab[-1]) | (lead != lead[-1]))
            keep = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if keep == 0 and len(tab) >= 16 * CHUNK:
                keep = len(tab) // CHUNK * CHUNK  # a huge group leaves in chunks
                yield from flush(tuple(p[:keep] for p in part), True, True)
                first = True  # what follows belongs to the same group
            elif keep:
                yield from flush(tuple(p[:keep] for p in part), first, False)
                first = False
            held = tuple(p[keep:] for p in part)
        if held is not None and len(held[0]):
            yield from flush(held, first, True)

    found = write_table(dealt.select("tab", "lead", "v", "fp").mapInArrow(cut, _CUT), "simhash-cut")
    edges = found.filter("kind = 'edge'").select("a", "b")
    chunks = found.filter("kind = 'chunk'").select("tab", "lead", "chunk", "mask", "pattern", "ids", "fps")
    nodes = chunks.select("tab", "lead", "chunk", "mask", "pattern")
    other = nodes.select("tab", "lead", *[F.col(c).alias(f"{c}2") for c in ("chunk", "mask", "pattern")])
    apart = sum((F.bit_count(F.col("pattern")[j].bitwiseXOR(F.col("pattern2")[j]).bitwiseAND(F.col("mask")[j])
                             .bitwiseAND(F.col("mask2")[j])) for j in range(width)), F.lit(0))
    pairs = write_table(nodes.join(other, ["tab", "lead"]).filter((F.col("chunk") < F.col("chunk2")) & (apart <= most))
                        .select("chunk", "chunk2"), "simhash-pairs")

    def compare(batches):
        for batch in batches:
            for i1, f1, i2, f2 in zip(*(batch.column(c) for c in range(4))):
                v = np.concatenate([i1.values.to_numpy(), i2.values.to_numpy()])
                x, y = (f.values.to_numpy().view(np.uint64).reshape(-1, width) for f in (f1, f2))
                up, low = _between(x, y, most)
                yield pa.RecordBatch.from_arrays([pa.array(v[up]), pa.array(v[low])], ["a", "b"])

    full = (pairs.join(chunks.select("chunk", "ids", "fps"), "chunk")
            .join(chunks.select(F.col("chunk").alias("chunk2"), F.col("ids").alias("ids2"), F.col("fps").alias("fps2")), "chunk2")
            .select("ids", "fps", "ids2", "fps2"))
    return edges.unionByName(full.mapInArrow(compare, "a long, b long"))


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 3, width: int = 1, most: int = 3) -> DataFrame:
    """(key, fp, component_id) per input row: the smallest key reachable over links, itself included.

    Equal fingerprints always link, all-zero ones (no word) too. Rows repeated
    with one key link through their texts like any others. A component's id
    ignores null keys; it is null if all its keys are. No rows, no result rows.
    """
    rows = write_table(fingerprints(df, key, text, words, width).withColumn("v", vertex(F.col("fp"), width)), "simhash-rows")
    classes = write_table(rows.groupBy("v").agg(F.min("key").alias("least"), F.first("fp").alias("fp")), "simhash-classes")
    edges = link_edges(classes.select("v", "fp"), width, most)
    roots = write_table(classes.select("v", "least").join(connected_components(edges), "v", "left")
                        .select("v", "least", F.coalesce("root", "v").alias("root")), "simhash-roots")
    ids = write_table(roots.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    named = write_table(roots.join(ids, "root").select("v", "component_id"), "simhash-named")
    return rows.join(named, "v").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(df: DataFrame, key: str, text: str, words: int, width: int, most: int) -> DataFrame:
    """Rows of ``df``, all columns, whose key is its component's smallest; one row per key.

    Rows with a null key cannot be named as a copy of anything and stay.
    """
    found = near_duplicates(df.filter(F.col(key).isNotNull()), key, text, words, width, most)
    first = write_table(found.filter(F.col(key) == F.col("component_id")).select(key).distinct(), "simhash-first")
    kept = df.join(first, key, "left_semi").dropDuplicates([key]).select(*df.columns)
    return kept.unionByName(df.filter(F.col(key).isNull()))
