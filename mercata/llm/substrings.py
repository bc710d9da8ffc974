"""Removal of repeated passages with one FM-index per shard.

A repeated window must meet its copies in one shard, and only repeated text
should travel. Each window of words has an anchor, its smallest hashed word
group, which copies share. Anchors that occur once rule out their windows.
Runs of windows around the others become segments; equal segments collapse to
their earliest occurrence before they are shuffled by anchor. A shard indexes
its distinct segments and streams them through a backward search over the
wavelet tree; windows that match elsewhere come back with their earliest place.
Anchors with very many distinct segments deal single windows by content instead.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.llm.fmindex import repeated_windows
from mercata.llm.text import mix, word_hashes
from mercata.session import drop_table, release_shuffles, write_table

WINDOW = 20
#: Words in an anchor.
GROUP = 6
#: Bytes of input text per shard.
SHARD_BYTES = 8 << 20
#: Distinct segments of one anchor beyond which its windows are dealt one by one.
CROWDED = 1000
_RUN = 4096  # windows around one anchor are fewer


def anchors(words: np.ndarray, window: int, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word group, place of each window's anchor): the leftmost smallest group inside the window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - group + 1].copy()
    for i in range(1, group):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : len(words) - group + 1 + i]
    h = mix(h)
    at, have, width = np.arange(len(h)), 1, window - group + 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return h, at


def _words(text: str | None) -> np.ndarray:
    return word_hashes(text.encode())[0] if text else np.zeros(0, np.uint64)


def _runs(at: np.ndarray) -> np.ndarray:
    """First window of each run with one anchor place."""
    return np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text): ``th`` tells rows of one key with different texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, spans): word spans (s, e) to remove from ``docs`` (id, th, text; see ``_documents``), maybe overlapping.

    One row a document; rows repeated with one id and text are one document.
    """
    if window >= _RUN:
        raise ValueError(f"a window has fewer than {_RUN} words")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def places(batches):
        """Anchors of all documents."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part, found, times, rows = batch.slice(start, 1024), [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    h, at = anchors(_words(t), window)
                    own, n = np.unique(h[at[_runs(at)]], return_counts=True)
                    found.append(own)
                    times.append(n)
                    rows.append(np.full(len(own), i))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(found).view(np.int64)),
                     pa.array(np.concatenate(times), pa.int64())], ["id", "th", "anchor", "n"])

    anchored = docs.select("id", "th", "text").mapInArrow(places, "id long, th long, anchor long, n long")
    # Pre-aggregated in each task; two occurrences in one document count as two.
    repeated = write_table(anchored.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "sub-anchors")
    hits = write_table(anchored.select("id", "th", "anchor").join(repeated, "anchor", "left_semi")
                       .groupBy("id", "th").agg(F.collect_list("anchor").alias("anchors")), "sub-hits")
    release_shuffles(spark)

    def cut(batches):
        """Segments: runs of windows around a repeated anchor."""
        for batch in batches:
            ids, ths, out = [], [], []
            for i, th, t, wanted in zip(*(batch.column(c) for c in range(4))):
                words = _words(t.as_py())
                h, at = anchors(words, window)
                first = _runs(at)
                stop = np.append(first[1:], len(at))
                own = h[at[first]]
                keep = np.isin(own, wanted.values.to_numpy().view(np.uint64))
                short = (words >> np.uint64(32)).astype(np.uint32)
                for a, b, anchor in zip(first[keep].tolist(), stop[keep].tolist(), own[keep].view(np.int64).tolist()):
                    out.append((a, b - a, anchor, short[a : b + window - 1].tobytes()))
                n = int(keep.sum())
                ids.extend([i.as_py()] * n)
                ths.extend([th.as_py()] * n)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), *map(pa.array, zip(*out))], names)
                    ids, ths, out = [], [], []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), *map(pa.array, zip(*out))], names)

    names = ["id", "th", "at", "n", "anchor", "words"]
    segments = docs.join(hits, ["id", "th"]).select("id", "th", "text", "anchors").mapInArrow(
        cut, "id long, th long, at long, n long, anchor long, words binary")
    segments = write_table(segments.select("id", "th", "at", "n", "anchor", "words", F.xxhash64("words").alias("c1"),
                                           F.xxhash64(F.lit(1), "words").alias("c2")), "sub-segments")
    release_shuffles(spark)
    earliest = F.min(F.struct("id", "th", "at"))
    distinct = write_table(segments.groupBy("c1", "c2").agg(F.first("anchor").alias("anchor"), F.first("words").alias("words"),
                                                            earliest.alias("o"))
                           .select("c1", "c2", "anchor", "words", "o.*"), "sub-distinct")
    release_shuffles(spark)
    crowded = write_table(distinct.groupBy("anchor").count().filter(F.col("count") > CROWDED).select("anchor"), "sub-crowded")

    def split(batches):
        """Single windows of the segments of crowded anchors."""
        for batch in batches:
            out = []
            for i, th, at, words in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend((i, th, at + k, words[4 * k : 4 * (k + window)]) for k in range(len(words) // 4 - window + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["id", "th", "at", "words"])

    every_single = distinct.join(crowded, "anchor", "left_semi").select("id", "th", "at", "words").mapInArrow(
        split, "id long, th long, at long, words binary")
    every_single = write_table(every_single.select("*", F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(1), "words").alias("c2")),
                               "sub-windows")
    singles = write_table(every_single.groupBy("c1", "c2").agg(F.first("words").alias("words"), earliest.alias("o"))
                          .select("c1", "c2", "words", "o.*"), "sub-singles")
    indexed = (distinct.join(crowded, "anchor", "left_anti").select(F.col("anchor").alias("route"), "id", "th", "at", "words")
               .unionByName(singles.select(F.col("c1").alias("route"), "id", "th", "at", "words")))
    indexed = (indexed.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int"))
               .repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "id", "th", "at", "words"))

    def search(batches):
        def close(rows):
            texts = [np.frombuffer(r[4], np.uint32) for r in rows]
            segment, offset, lowest, begins = repeated_windows(texts, window)
            if not len(segment):
                return
            docs_ = np.array([(r[1], r[2]) for r in rows], np.int64)
            at = np.array([r[3] for r in rows], np.int64)
            _, number = np.unique(docs_, axis=0, return_inverse=True)
            # Each text place's key: document in order, then word; places between segments never match.
            sizes = np.array([len(t) for t in texts])
            keys = np.full(int(sizes.sum()) + len(texts) + 1, np.iinfo(np.int64).max)
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys[np.repeat(begins, sizes) + inner] = np.repeat((number.ravel() << 40) + at, sizes) + inner
            again = lowest(keys) < (number.ravel()[segment] << 40) + at[segment] + offset
            segment, start = segment[again], at[segment[again]] + offset[again]
            if len(segment):
                joins = np.append(True, (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1))
                a = np.flatnonzero(joins)
                b = np.append(a[1:], len(start)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(docs_[segment[a], 0]), pa.array(docs_[segment[a], 1]),
                                                  pa.array(start[a]), pa.array(start[b] + window)], ["id", "th", "s", "e"])

        shard, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != shard and rows:
                    yield from close(rows)
                    rows = []
                shard = row[0]
                rows.append(row)
        if rows:
            yield from close(rows)

    found = indexed.mapInArrow(search, "id long, th long, s long, e long")
    # Segments seen before, whole: all their windows start earlier at the first occurrence. A document's later
    # occurrences are its own less those that came first, so both sides meet on the document, once.
    def later(rows: DataFrame, least: DataFrame) -> DataFrame:
        sets = [t.groupBy("id", "th").agg(F.collect_set(F.col("at") * _RUN + F.col("n")).alias(c)) for t, c in ((rows, "own"), (least, "first"))]
        left = F.array_except("own", F.coalesce("first", F.array().cast("array<long>")))
        spans = F.transform(left, lambda x: F.struct(F.floor(x / _RUN).alias("s"), (F.floor(x / _RUN) + x % _RUN + (window - 1)).alias("e")))
        return sets[0].join(sets[1], ["id", "th"], "left").filter(F.size(left) > 0).select("id", "th", spans.alias("spans"))

    runs = F.floor(F.length("words") / 4) - (window - 1)
    whole = later(segments.select("id", "th", "at", "n"), distinct.select("id", "th", "at", runs.alias("n")))
    # The same for single windows of crowded anchors.
    one = F.lit(1).cast("long").alias("n")
    single = later(every_single.select("id", "th", "at", one), singles.select("id", "th", "at", one))
    # At most one row a document from each source.
    found = found.groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = write_table(found.unionByName(whole).unionByName(single).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")),
                        "sub-spans")
    for table in (repeated, hits, segments, distinct, crowded, every_single, singles):
        drop_table(table)
    release_shuffles(spark)
    return spans


def _kept(text: str, spans) -> tuple[int, list[bytes]]:
    """(number of words, words left) of a text without its spans (an Arrow list of (s, e), maybe null)."""
    words = text.encode().split()
    n = len(words)
    if spans.is_valid:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, spans.values.field(0).to_numpy(), 1)
        np.add.at(edge, spans.values.field(1).to_numpy(), -1)
        words = [w for w, stays in zip(words, (np.cumsum(edge[:-1]) == 0).tolist()) if stays]
    return n, words


def _with_spans(df: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``df`` with a last column of its rows' spans to remove."""
    spans = repeated_spans(_documents(df, key, text), window)
    spans = spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    rows = df.select("*", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__id"),
                     F.xxhash64(F.coalesce(text, F.lit(""))).alias("__th"))
    return rows.join(spans, ["__id", "__th"], "left").select(*df.columns, "__spans")


def remove_repeats(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept) per input row: the words left, joined by one space.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: at a smaller key, or in the same row at an earlier word. Null keys
    come first; rows of one key are ordered by a hash of their texts, and rows
    equal in both count as one document (each gets its result). Null and short
    texts lose nothing. Words are compared by 32-bit hashes, all ``window`` of them.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _with_spans(df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")), "key", "text", window)

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [_kept(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(w) for n, w in found], pa.int64()),
                     pa.array([b" ".join(w).decode() for _, w in found], pa.string())], ["key", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(keep, f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def strip_repeats(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """``df``, all rows and columns, with repeated passages gone from ``text`` (see ``remove_repeats``).

    Texts that lose words are rebuilt with single spaces; all others stay as they are.
    """
    rows, at = _with_spans(df, key, text, window), df.columns.index(text)

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for t, s in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1)):
                    out.append(b" ".join(_kept(t or "", s)[1]).decode() if s.is_valid else t)
                columns = part.columns[:-1]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return rows.mapInArrow(keep, df.schema)
