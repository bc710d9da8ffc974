"""BPE encoding as a bounded-lookahead transducer, decoding as a byte-to-text state machine.

Merging a longer text can only change tokens near its end. ``lookahead``
computes from the merge list how near: if two texts agree up to position e,
their merges differ first where a merge reaches over e, and the border left of
which both runs agree can only move on when a later merge takes a token that
ends at the border together with one that starts there. A border that arrived
by merge j = (l, r) stands before l, so the next merge k = (l', r') must come
later and r' must be l or have grown from l by merges on its right. The
longest such chain, weighed by the lengths of its left parts, bounds the
change; every token that ends at least that far before the end is final.

The transducer buffers symbols of one pre-token, emits what is final and keeps
the rest, so its memory does not grow with the text. Pre-tokens short enough
to fit the buffer are merged at once and kept in a bounded cache.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: White space of the tokenizer's normaliser (Unicode White_Space), a fixed value.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Larger than any rank and id.
NEVER = 1 << 62
#: Words held per task in the cache's younger part; when it is full it becomes the older part, whose words go unless used again.
CACHE_WORDS = 200_000
#: Rows handled between two output batches.
SLICE = 512


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Model:
    """Merge list, vocabulary and pre-tokenisation of a word-suffix BPE tokenizer file."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("not a plain BPE file without decoder")
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unexpected normaliser")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE), regex.V1)
        self.space = regex.compile(f"[{SPACE}]+")
        self.markers = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.first = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.merges: dict[int, int] = {}
        self.order: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merges[a << 32 | b] = rank << 32 | made
            self.order.append((a, b, made))
        self.lookahead = lookahead(self.order)

    def normalise(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # Lower case goes letter by letter: no special form for a final sigma.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


    def library_pieces(self, text: str) -> list[bytes]:
        """Normalised pre-tokens by the library itself: its Unicode tables may be newer than Python's."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.spec)
            self.back = {ord(c): bytes([b]) for b, c in enumerate(byte_symbols())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [b"".join(self.back[ord(c)] for c in piece) for piece, _ in found]


def lookahead(order: list[tuple[int, int, int]]) -> int:
    """Sufficient lookahead, in symbols, of a merge list given as (left, right, made) ids."""
    made_by: dict[int, tuple[int, int]] = {}
    length: dict[int, int] = {}
    best: dict[int, int] = {}  # longest chain whose border stands before this token
    out = 0
    for a, b, made in order:
        reach, t = 0, b
        while True:
            reach = max(reach, best.get(t, 0))
            if t not in made_by:
                break
            t = made_by[t][0]  # b has grown from this token
        reach += length.get(a, 1)
        out = max(out, reach)
        best[a] = max(best.get(a, 0), reach)
        length[made] = length.get(a, 1) + length.get(b, 1)
        made_by.setdefault(made, (a, b))
    return out


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply the merge list to a short symbol sequence (in place): lowest rank first, left to right."""
    get = merges.get
    found = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
    while found:
        low = min(found)
        if low == NEVER:
            break
        i = found.index(low)
        ids[i] = made = low & 0xFFFFFFFF
        del ids[i + 1], found[i]
        if i < len(found):
            found[i] = get(made << 32 | ids[i + 1], NEVER)
        if i:
            found[i - 1] = get(ids[i - 1] << 32 | made, NEVER)
    return ids


def merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """``merge`` for a long sequence: a heap of candidate pairs over a linked list."""
    n = len(ids)
    ids, prev, nxt = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (m := merges.get(ids[i] << 32 | ids[j])):
            heappush(heap, (m >> 32, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = merges[a << 32 | b] & 0xFFFFFFFF, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [t for t in ids if t >= 0]


class Transducer:
    """Streams one pre-token: ``feed`` symbols, get final tokens; ``finish`` ends it."""

    def __init__(self, model: Model):
        self.model, self.buffer = model, []
        self.room = max(256, 4 * model.lookahead)

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        length: dict[int, int] = {}
        for s in symbols:
            self.buffer.append(s)
            if len(self.buffer) >= self.room:
                tokens = merge_long(self.buffer, self.model.merges)
                done, limit = 0, len(self.buffer) - self.model.lookahead
                for t in tokens:
                    if t not in length:
                        length[t] = len(self.model.tokens[t].removesuffix(self.model.suffix))
                    if done + length[t] > limit:
                        break
                    done += length[t]
                    yield t
                del self.buffer[:done]  # encoding goes on from a token border

    def finish(self) -> Iterator[int]:
        yield from merge_long(self.buffer, self.model.merges)
        self.buffer.clear()


class Encoder(dict):
    """Cache of white-space separated words (UTF-8) to their ids (int32 bytes)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.short = model, max(64, model.lookahead)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.merged(word)
        if len(word) <= self.short:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merged(self, word: bytes) -> bytes:
        m, out = self.model, array("i")
        text = word.decode()
        if text.isascii():
            pieces = map(str.encode, m.pattern.findall(text.lower()))
        elif max(text) < "\u0250":
            pieces = map(str.encode, m.pattern.findall(m.normalise(text)))
        else:
            pieces = m.library_pieces(text)
        for data in pieces:
            if len(data) <= self.short:
                symbols = [m.first[b] for b in data]
                symbols[-1] = m.last[data[-1]]
                out.extend(merge(symbols, m.merges))
            else:
                stream = Transducer(m)
                out.extend(stream.feed(m.first[b] for b in data[:-1]))
                out.extend(stream.feed([m.last[data[-1]]]))
                out.extend(stream.finish())
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; special tokens' strings give their ids, as in the library."""
        if not text:
            return b""
        if self.model.markers is None or "<|" not in text:
            return b"".join(map(self.__getitem__, text.encode().split()))
        out = []
        for piece in self.model.markers.split(text):
            mark = self.model.special.get(piece)
            out.append(np.int32(mark).tobytes() if mark is not None
                       else b"".join(map(self.__getitem__, piece.encode().split())))
        return b"".join(out)


class Decoder:
    """Ids to text, piece by piece.

    ``mode='tokens'``: token strings joined by spaces, as the library decodes
    for a file without decoder. ``mode='text'``: byte symbols back to bytes,
    word ends to spaces, through an incremental UTF-8 decoder that holds an
    unfinished character (at most 3 bytes) between calls; broken ones become
    U+FFFD. Unknown ids are skipped.
    """

    def __init__(self, model: Model, mode: str = "tokens"):
        self.mode, self.model, self.begun = mode, model, False
        if mode == "text":
            back = {c: b for b, c in enumerate(byte_symbols())}
            self.bytes = {i: bytes(back[c] for c in t.removesuffix(model.suffix)) + b" " * t.endswith(model.suffix)
                          for t, i in model.vocab.items()} | {i: t.encode() for t, i in model.special.items()}
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "text":
            return self.state.decode(b"".join(self.bytes.get(i, b"") for i in ids))
        found = list(filter(None, map(self.model.tokens.get, ids)))
        head = " " if self.begun and found else ""
        self.begun = self.begun or bool(found)
        return head + " ".join(found)

    def finish(self) -> str:
        tail = self.state.decode(b"", True) if self.mode == "text" else ""
        if self.mode == "text":
            self.state.reset()
        self.begun = False
        return tail


def _shared(df: DataFrame, path: str):
    """The tokenizer file, read once on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<int>) per input row; null and empty texts give an empty list."""
    spec, kind = _shared(df, path), df.schema[key].dataType.simpleString()

    def run(batches):
        encoder = Encoder(Model(spec.value))
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "ids"])

    return (df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>")
            .withColumnRenamed("key", key))


def encode_and_decode(df: DataFrame, key: str, text: str, path: str, mode: str = "tokens") -> DataFrame:
    """(key, ids array<int>, decoded) per input row, in one pass: what ``decode`` of ``encode`` gives.

    Null and empty texts give an empty list and ''; an empty table gives no
    rows; long texts are decoded piece by piece.
    """
    spec, kind = _shared(df, path), df.schema[key].dataType.simpleString()

    def run(batches):
        model = Model(spec.value)
        encoder, decoder = Encoder(model), Decoder(model, mode)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part, ids, texts = batch.slice(a, SLICE), [], []
                for t in part.column(1).to_pylist():
                    found = encoder.encode(t)
                    ids.append(found)
                    flat = np.frombuffer(found, np.int32)
                    texts.append("".join([*(decoder.feed(flat[i : i + 65_536].tolist()) for i in range(0, len(flat), 65_536)), decoder.finish()]))
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    return (df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
            .withColumnRenamed("key", key))


def decode(df: DataFrame, ids: str, path: str, mode: str = "tokens") -> DataFrame:
    """``df`` with a column ``decoded`` (replacing one of that name); null ids decode to ''."""
    spec = _shared(df, path)
    rest = [c for c in df.columns if c != "decoded"]
    schema = df.select(*rest).schema.add("decoded", "string")
    at = rest.index(ids)

    def run(batches):
        decoder = Decoder(Model(spec.value), mode)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                lists, out = part.column(at), []
                flat = lists.values.to_numpy(zero_copy_only=False)
                offsets = lists.offsets.to_numpy()
                for s, e in zip(offsets[:-1], offsets[1:]):
                    text = [decoder.feed(flat[i : min(i + 65_536, e)].tolist()) for i in range(s, e, 65_536)]
                    out.append("".join([*text, decoder.finish()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*rest, "decoded"])

    return df.select(*rest).mapInArrow(run, schema)
