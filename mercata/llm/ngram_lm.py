"""N-gram scoring with sharded Elias-Fano tries.

Documents are cut into batches of about two million tokens. A batch turns its
tokens into a small trie of distinct n-grams (words as hashes) with their
counts in training documents, cut by shard: an n-gram lives in the shard of its
first word, and words that alone would overfill a shard are dealt on by their
second word. A shard adds up its pieces into one Elias-Fano trie with exact
word counts and 8-bit codes of smoothed probabilities, looks the batches'
n-grams up in it and answers with codes in the batch's own order. The batch's
tokens, kept as word numbers, then meet the answers and become scores. Only
distinct n-grams of a batch are shuffled, texts never.

Model: P(w | h) = c(hw) / (c(h) + m) + m / (c(h) + m) P(w | h'), where h' drops
the first word of h, down to the add-0.1 unigram estimate.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.llm.eliasfano import Trie, dequantise, quantise
from mercata.llm.text import distinct, mix, ordered, word_hashes
from mercata.session import release_shuffles, write_table

#: Reserved word hashes: the end of a text and the blank before its first word.
END, BEGIN = 0x9E6D62D06F6A9A9B, 0x5851F42D4C957F2D
#: Pseudo-counts m for contexts of one and two words.
PSEUDO = (20.0, 5.0)
ALPHA = 0.1
BATCH_TOKENS = 1 << 21
#: Tokens of a batch that are scored at a time.
SOME_TOKENS = 1 << 18
#: Bytes of text per shard.
SHARD_BYTES = 8 << 20
#: Contexts dealt on by their second word, at most: the list goes to every task. Results do not depend on it.
MOST_SPREAD = 1 << 16


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed piece (their types are known to the reader)."""
    body = b"".join(np.array([a.nbytes], np.int64).tobytes() + a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(piece: bytes | memoryview, *kinds) -> list[np.ndarray]:
    body = pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an END after each text, number of tokens of each text)."""
    found, sizes, group, size = [], [], [], 0
    for i, text in enumerate(texts):
        group.append(text.encode() if text else b"")
        size += len(group[-1])
        if size >= 1 << 20 or i == len(texts) - 1:  # about a megabyte at a time
            h, n = _hash_texts(group)
            found.append(h)
            sizes.append(n)
            group, size = [], 0
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(sizes)


def _hash_texts(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, start, _ = word_hashes(b" ".join(datas).lower())
    sizes = np.fromiter(map(len, datas), np.int64, len(datas))
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = np.diff(np.append(np.searchsorted(start, begins), len(start)))
    out = np.full(len(hashes) + len(datas), END, np.uint64)
    body = np.ones(len(out), bool)
    body[np.cumsum(words + 1) - 1] = False
    out[body] = hashes
    return out, words + 1


class BatchTrie:
    """Distinct n-grams (n = 1..3) of a batch, in shard order; the same tokens always give the same order.

    Roots are all words (and BEGIN) at their home shard, and each spread
    context once more in every shard that holds children of it.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray, shards: int, hot: np.ndarray):
        """``words``: the batch's distinct tokens, ascending; ``at``: the number of each token among them (int32)."""
        first = np.zeros(len(at), bool)
        first[np.cumsum(sizes) - sizes] = True
        self.later = ~first
        begin = int(np.searchsorted(words, np.uint64(BEGIN)))
        names = np.insert(words, begin, np.uint64(BEGIN))
        own = at + (at >= begin)  # 32-bit, as all arrays by token
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = begin
        del first
        child = (mix(names) >> np.uint64(32)).astype(np.uint32)[own]
        base = self._shard(names, shards).astype(np.uint64) << np.uint64(32) | np.arange(len(names), dtype=np.uint64)
        spread = np.flatnonzero(np.isin(names, hot)[before])
        place = self._shard(names[before[spread]] * np.uint64(31) + names[own[spread]], shards)
        extra = place.astype(np.uint64) << np.uint64(32) | before[spread].astype(np.uint64)
        self.roots = np.unique(np.concatenate([base, extra]))
        self.root_shard = (self.roots >> np.uint64(32)).astype(np.int64)
        self.root_word = names[(self.roots & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        at_home = np.searchsorted(self.roots, base).astype(np.int32)
        self.n1 = at_home[own]
        self.up1 = at_home[before]
        self.up1[spread] = np.searchsorted(self.roots, extra)
        del own, before, spread, place, extra, base, names, at_home
        self.k2, self.n2 = self._distinct(self.up1, child, len(self.roots))
        child = child[self.later]
        self.k3, self.n3 = self._distinct(self.n2[:-1][self.later[1:]], child, len(self.k2))

    @staticmethod
    def _distinct(parents: np.ndarray, child: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        keys = parents.astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= child
        return distinct(keys, 32 + max(1, most.bit_length()))

    @staticmethod
    def _shard(words: np.ndarray, shards: int) -> np.ndarray:
        return (mix(words + np.uint64(0x1234567)) % np.uint64(shards)).astype(np.int64)

    def pieces(self, train: np.ndarray, shards: int):
        """(shard, packed piece) of each shard with n-grams here; ``train``: tokens that count."""
        c1 = np.bincount(self.n1[train], minlength=len(self.roots)).astype(np.int32)
        c2 = np.bincount(self.n2[train], minlength=len(self.k2)).astype(np.int32)
        c3 = np.bincount(self.n3[train[self.later]], minlength=len(self.k3)).astype(np.int32)
        p2, p3 = (self.k2 >> np.uint64(32)).astype(np.int32), (self.k3 >> np.uint64(32)).astype(np.int32)
        f1 = np.bincount(p2, minlength=len(self.roots)).astype(np.int32)
        f2 = np.bincount(p3, minlength=len(self.k2)).astype(np.int32)
        i2, i3 = self.k2.astype(np.uint32), self.k3.astype(np.uint32)
        a1 = np.searchsorted(self.root_shard, np.arange(shards + 1))
        a2 = np.searchsorted(p2, a1)
        a3 = np.searchsorted(p3, a2)
        for s in np.flatnonzero(np.diff(a1)):
            x, y, z = slice(a1[s], a1[s + 1]), slice(a2[s], a2[s + 1]), slice(a3[s], a3[s + 1])
            yield int(s), _pack(self.root_word[x], c1[x], f1[x], i2[y], c2[y], f2[y], i3[z], c3[z])


_PIECE = (np.uint64, np.int32, np.int32, np.uint32, np.int32, np.int32, np.uint32, np.int32)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = ordered(keys, int(keys.max()).bit_length() if len(keys) else 1)
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts.astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)


def build_trie(pieces: list[bytes | memoryview], hot: dict[int, int]):
    """A shard's trie over n-grams seen in training, as a memory map.

    ``hot``: training counts of contexts whose children are spread over shards.
    Those asked for here stay even if all their training children fell in other
    shards: their back-off weight is the same everywhere.
    """
    cols = [_unpack(p, *_PIECE) for p in pieces]
    given = np.array([w for w, n in hot.items() if n], np.uint64)
    seen = [(w[(c > 0) | np.isin(w, given) | (np.add.reduceat(np.append(c2, 0), np.minimum(np.cumsum(f) - f, len(c2))) * (f > 0) > 0)],)
            for w, c, f, _, c2, _, _, _ in cols]
    words = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, np.uint64)
    c1 = np.zeros(len(words), np.int64)
    k2, n2, k3, n3 = [], [], [], []
    for w, c, f, _, _, _, _, _ in cols:
        at = np.searchsorted(words, w[c > 0])
        c1[at] += c[c > 0]
    for w, c, f1, i2, c2, f2, i3, c3 in cols:
        parent = np.repeat(np.searchsorted(words, w), f1).astype(np.uint64) << np.uint64(32) | i2
        k2.append(parent[c2 > 0])
        n2.append(c2[c2 > 0])
    k2, n2 = _sum_by(np.concatenate(k2), np.concatenate(n2)) if cols else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for w, c, f1, i2, c2, f2, i3, c3 in cols:
        keep = c3 > 0
        parent = np.repeat(np.searchsorted(words, w), f1).astype(np.uint64) << np.uint64(32) | i2
        at = np.searchsorted(k2, np.repeat(parent, f2)[keep])
        k3.append(at.astype(np.uint64) << np.uint64(32) | i3[keep])
        n3.append(c3[keep])
    k3, n3 = _sum_by(np.concatenate(k3), np.concatenate(n3)) if cols else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    p2, p3 = (k2 >> np.uint64(32)).astype(np.int64), (k3 >> np.uint64(32)).astype(np.int64)
    low = np.uint64(0xFFFFFFFF)
    f1, f2 = np.bincount(p2, minlength=len(words)), np.bincount(p3, minlength=len(k2))
    # Times a context was followed by anything: its children's counts, or the count it was given.
    h1 = np.bincount(p2, weights=n2, minlength=len(words))
    for word, count in hot.items():
        at = np.searchsorted(words, np.uint64(word))
        if at < len(words) and words[at] == np.uint64(word):
            h1[at] = count
    h2 = np.bincount(p3, weights=n3, minlength=len(k2))
    codes = [np.zeros(len(words), np.uint8), quantise(n2 / (h1[p2] + PSEUDO[0])), quantise(n3 / (h2[p3] + PSEUDO[1]))]
    weights = [quantise(PSEUDO[0] / (h1 + PSEUDO[0])), quantise(PSEUDO[1] / (h2 + PSEUDO[1])), np.zeros(len(k3), np.uint8)]
    return Trie.build([words, k2 & low, k3 & low], [f1, f2], c1, codes, weights)


def answer(trie: Trie, piece: bytes | memoryview) -> bytes:
    """Codes for a batch's n-grams: word counts and weights, bigram codes and weights, trigram codes."""
    words, _, f1, i2, _, f2, i3, _ = _unpack(piece, *_PIECE)
    a = trie.find(0, None, words)
    b = trie.find(1, np.repeat(a, f1), i2)
    c = trie.find(2, np.repeat(b, f2), i3)
    whole = np.uint8(255)  # weight 1: nothing known about the context

    def take(values, at, none):
        return np.where(at >= 0, values[np.maximum(at, 0)], none) if len(values) else np.full(len(at), none)

    (_, _, count, _, w1), (_, _, _, q2, w2), (_, _, _, q3, _) = trie.levels
    return _pack(take(count, a, 0).astype(np.int64), take(w1, a, whole).astype(np.uint8), take(q2, b, 0).astype(np.uint8),
                 take(w2, b, whole).astype(np.uint8), take(q3, c, 0).astype(np.uint8))


_ANSWER = (np.int64, np.uint8, np.uint8, np.uint8, np.uint8)


def _batches(source, lead: int):
    """Cut a task's rows into batches: lists of (\\*lead columns, text) with bounded tokens."""
    held, size = [], 0
    for batch in source:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                held.append(row)
                size += len(row[lead] or "") // 6 + 1
                if size >= BATCH_TOKENS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def frequent_contexts(docs: DataFrame, shards: int) -> np.ndarray:
    """Words to deal on by their successor: those over a quarter of a shard's even share of some batch.

    A word over that share overall is over it in some batch. What else is named
    is dealt on needlessly but rightly; BEGIN always is.
    """
    def frequent(batches):
        for rows in _batches(batches, 0):
            tokens, _ = tokens_of([r[0] for r in rows])
            tokens.sort()
            cut = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            over = np.diff(np.append(cut, len(tokens))) * 4 * shards >= max(len(tokens), 4000)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[cut[over]].view(np.int64))], ["w"])

    found = docs.select("text").mapInArrow(frequent, "w long").groupBy("w").agg(F.count("*").alias("n"))
    names = [r[0] & 0xFFFFFFFFFFFFFFFF for r in found.orderBy(F.desc("n"), "w").limit(min(8 * shards, MOST_SPREAD)).collect()]
    return np.array(sorted({*names, BEGIN} - {END}), np.uint64)


def score(df: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) per input row.

    Learns from rows where ``train`` holds. Tokens: words, A-Z lower-cased, then
    one end; null texts are empty (one token). n_known: tokens seen in training;
    base_score: log10 of the add-0.1 unigram probability; score: log10 of the
    interpolated trigram probability. Without training rows every probability
    is that of an unseen token in an empty vocabulary.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    spread = frequent_contexts(docs, shards)

    def tokenise(batches):
        seq = TaskContext.get().partitionId() << 32
        for rows in _batches(batches, 2):
            tokens, sizes = tokens_of([r[2] for r in rows])
            flags = np.array([r[1] for r in rows], bool)
            words, number = distinct(tokens, 64)
            counts = np.zeros(len(spread), np.int64)  # how often training texts go on after each spread context
            at = np.minimum(np.searchsorted(words, spread), len(words) - 1)
            known = np.bincount(number[np.repeat(flags, sizes)], minlength=len(words))
            counts[:] = np.where(words[at] == spread, known[at], 0)
            counts[spread == np.uint64(BEGIN)] = flags.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(key_type)),
                 pa.array([flags.tolist()], pa.list_(pa.bool_())), pa.array([_pack(words, number, sizes)], pa.binary()),
                 pa.array([counts.tolist()], pa.list_(pa.int64()))], ["batch", "keys", "flags", "body", "counts"])
            seq += 1

    from pyspark.sql.pandas.types import to_arrow_type
    key_type = to_arrow_type(df.schema[key].dataType)
    # Batches are written once: what follows must see the same ones, in the same order.
    parts = write_table(docs.mapInArrow(tokenise, f"batch long, keys array<{kind}>, flags array<boolean>, body binary, "
                                                  "counts array<long>"), "lm-batches")
    sums = parts.select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n")).collect()
    hot = {int(spread[i]): n for i, n in sums}

    def split(batches):
        for b in batches:
            for batch, flags, body in zip(*b.columns):
                words, at, sizes = _unpack(memoryview(body.as_buffer()), np.uint64, np.int32, np.int64)
                trie = BatchTrie(words, at, sizes, shards, spread)
                del words, at
                learnt = np.repeat(flags.values.to_numpy(zero_copy_only=False).astype(bool), sizes)
                for s, piece in trie.pieces(learnt, shards):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([batch.as_py()], pa.int64()), pa.array([piece], pa.binary())],
                        ["shard", "batch", "body"])

    def serve(source):
        def close(shard, pieces):
            trie = Trie(build_trie([p for _, p in pieces], hot))
            count = trie.levels[0][2]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([shard], pa.int32()), pa.nulls(1, pa.binary()),
                 pa.array([int((count > 0).sum())], pa.int64()), pa.array([int(count.sum())], pa.int64())], out)
            for batch, piece in pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch], pa.int64()), pa.array([shard], pa.int32()), pa.array([answer(trie, piece)], pa.binary()),
                     pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], out)

        shard, pieces = None, []
        for b in source:
            for s, batch, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if s != shard and pieces:
                    yield from close(shard, pieces)
                    pieces = []
                shard = s
                pieces.append((batch, memoryview(body.as_buffer())))  # a view: no second copy of a task's pieces
        if pieces:
            yield from close(shard, pieces)

    out = ["batch", "shard", "body", "words", "tokens"]
    asked = (parts.select("batch", "flags", "body").mapInArrow(split, "shard int, batch long, body binary")
             .repartition(shards, "shard").sortWithinPartitions("shard", "batch"))
    answers = write_table(asked.mapInArrow(serve, "batch long, shard int, body binary, words long, tokens long"), "lm-answers")
    release_shuffles(df.sparkSession)
    totals = answers.agg(F.sum("words"), F.sum("tokens")).first()
    vocabulary, total = float(totals[0] or 0), float(totals[1] or 0)
    floor = total + ALPHA * (vocabulary + 1)

    def finish(source):
        def close(pieces):
            keys, flags = (c.values for c in pieces[0][:2])
            words, at, sizes = _unpack(pieces[0][2], np.uint64, np.int32, np.int64)
            trie = BatchTrie(words, at, sizes, shards, spread)
            del words, at
            trie.k2 = trie.k3 = None  # only the tokens' places are needed here
            count, w1, q2, w2, q3 = (np.concatenate(c) for c in zip(*(_unpack(p[2], *_ANSWER) for p in pieces[1:])))
            ends = np.cumsum(sizes)
            thirds = np.cumsum(trie.later, dtype=np.int32)
            a = 0
            while a < len(sizes):  # some texts at a time: about SOME_TOKENS tokens, or one text
                begin = int(ends[a] - sizes[a])
                b = max(a + 1, int(np.searchsorted(ends, begin + SOME_TOKENS, "right")))
                x = slice(begin, int(ends[b - 1]))
                c = count[trie.n1[x]]
                base = (c + ALPHA) / floor
                p = dequantise(q2[trie.n2[x]]) + dequantise(w1[trie.up1[x]]) * base
                third = np.flatnonzero(trie.later[x])  # a text's first token is none: its predecessor is in x as well
                if len(third):
                    last = int(thirds[x.stop - 1])
                    p[third] = dequantise(q3[trie.n3[last - len(third) : last]]) + dequantise(w2[trie.n2[x][third - 1]]) * p[third]
                starts = ends[a:b] - sizes[a:b] - begin
                add = lambda v: np.add.reduceat(v, starts)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), flags.slice(a, b - a), pa.array(sizes[a:b]), pa.array(add((c > 0).astype(np.int64))),
                     pa.array(np.full(b - a, int(total))), pa.array(add(np.log10(base))),
                     pa.array(np.minimum(add(np.log10(np.minimum(p, 1.0))), 0.0))], ["key", *columns])
                a = b

        now, pieces = None, []
        for b in source:
            for batch, keys, flags, body in zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4)):
                if pieces and batch != now:
                    yield from close(pieces)
                    pieces = []
                now = batch
                pieces.append((keys, flags, memoryview(body.as_buffer())))
        if pieces:
            yield from close(pieces)

    columns = ["train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    back = (parts.select("batch", F.lit(-1).alias("shard"), "keys", "flags", "body")
            .unionByName(answers.filter("batch is not null").select("batch", "shard", "body"), allowMissingColumns=True)
            .repartition("batch").sortWithinPartitions("batch", "shard").select("batch", "shard", "keys", "flags", "body"))
    scored = back.mapInArrow(finish, f"key {kind}, train boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double")
    return scored.withColumnRenamed("key", key)
