import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from helpers import SF, components, documents, no_documents, sf_rows, sha, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercata.llm import bpe, ngram_lm, packing, quality, sharding, simhash, substrings, syncmers
from mercata.llm.queries import QUERIES
from mercata.llm.text import distinct, ordered, word_count, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_hashes_follow_the_words():
    data = b" ".join(bytes(random.Random(1).choices(b"ab\xc3", k=1 + i % 5)) for i in range(4000))
    data += b" " + b"x" * 200_000 + b"\x0b" + b"x" * 200_000 + b" " + b"x" * 199_999
    h, s, e = word_hashes(data)
    w = data.split()
    assert [data[a:b] for a, b in zip(s, e)] == w
    assert len(set(zip(w, h.tolist()))) == len(set(w)) == len(set(h.tolist()))


def test_packed_sort_equals_argsort():
    r = np.random.default_rng(0)
    for n, bits, spread in ((0, 64, 1), (1, 64, 1), (5000, 64, 64), (5000, 64, 3), (5000, 53, 12), (70_000, 60, 60)):
        keys = r.integers(0, 1 << spread, n, dtype=np.uint64) << np.uint64(max(0, min(bits, 64) - spread) // 2)
        assert (ordered(keys, bits) == np.argsort(keys, kind="stable")).all()
        values, inverse = distinct(keys, bits)
        assert (values == np.unique(keys)).all() and (values[inverse] == keys).all()


# ------------------------------------------------------------ 1 quality

def test_quality_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf).collect()}
    ids = [r[0] for r in sf_rows(f"select doc_id from '{sf}/documents.parquet'")]
    assert sorted(got) == sorted(ids)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].score, q) for i, q in sf_rows(f"select doc_id, quality from '{sf}/labels.parquet'") if got[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_edge_cases(spark):
    rows, docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, "l"), (4, None, "l"), (16, 1, "l"), (16, 1, "l"), (None, 1, "l"), (999, 1, "l"), (7, 0, "l")],
                                   "doc_id long, quality int, text string")
    got = quality.classify(docs, labels, "doc_id", "text", "quality").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    none = quality.classify(docs, labels.limit(0), "doc_id", "text", "quality").collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(no_documents(spark), labels, "doc_id", "text", "quality").count() == 0
    kept = quality.keep_good(docs, labels.limit(0), "doc_id", "text", "quality")
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_class_prior_is_read_off_the_mixture(spark):
    rng = np.random.default_rng(2)
    x = np.zeros((4000, quality.FEATURES), np.float32)
    good = rng.random(4000) < 0.7
    x[:, 0] = rng.normal(size=4000) + 4 * good
    trusted = good & (rng.random(4000) < 0.3)
    rows = spark.createDataFrame([(r.tolist(), bool(t)) for r, t in zip(x, trusted)], "x array<float>, positive boolean")
    model = quality.fit(rows)
    assert abs(model.prior - 0.7) < 0.05
    assert ((model.score(x) >= 0.5) == good).mean() > 0.95


# ------------------------------------------------------------ 2 BPE

def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rows, docs = documents(spark)
    ids = bpe.encode(docs, "doc_id", "text", PATH)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(ids, "ids", PATH).collect())
    want = Counter()
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(e), lib.decode(e, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode(no_documents(spark), "doc_id", "text", PATH).count() == 0
    both = bpe.encode_and_decode(docs, "doc_id", "text", PATH).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both) == got
    assert bpe.encode_and_decode(no_documents(spark), "doc_id", "text", PATH).count() == 0


def test_bpe_cache_of_two_parts(monkeypatch):
    """Words that leave the cache and come back have the same ids, and no more words are held than two parts."""
    with open(PATH, encoding="utf-8") as f:
        model = bpe.Model(f.read())
    words = [f"word{i % 37}x{i % 11}" for i in range(2000)]
    want = [bpe.Encoder(model).encode(w) for w in words]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    encoder = bpe.Encoder(model)
    assert [encoder.encode(w) for w in words] == want
    assert len(encoder) <= 20 and len(encoder.older) <= 20


def test_bpe_streams_like_the_library():
    model, lib, r = bpe.Model(open(PATH).read()), Tokenizer.from_file(PATH), random.Random(3)
    coder = bpe.Encoder(model)
    for text in ("a" * 9000, "".join(r.choices("abcdeinthr", k=12_000)), "".join(r.choices("áéai", k=7000)), "!?" * 4000,
                 "ΣΑΣ Σ İI", "it's we'll I'VE 'd''s", *("".join(map(chr, r.choices(range(1, 0x3000), k=40))) for _ in range(300))):
        got = np.frombuffer(coder.encode(text), np.int32).tolist()
        assert got == lib.encode(text, add_special_tokens=False).ids
        split = r.randint(0, len(got))
        d = bpe.Decoder(model)
        assert d.feed(got[:split]) + d.feed(got[split:]) + d.finish() == lib.decode(got, skip_special_tokens=False)


def test_bpe_memory_and_lookahead():
    model = bpe.Model(open(PATH).read())
    stream = bpe.Transducer(model)
    emitted = 0
    for _ in range(200):
        emitted += sum(1 for _ in stream.feed([model.first[ord("a")]] * 100))
        assert len(stream.buffer) <= stream.room
    assert emitted > 0
    # a+b, then c+ab: one symbol to the right of c decides over it, two after a chain
    assert bpe.lookahead([(0, 1, 10)]) == 1
    assert bpe.lookahead([(0, 1, 10), (2, 10, 11)]) == 2


def test_bytes_come_back_as_text():
    model = bpe.Model(open(PATH).read())
    ids = np.frombuffer(bpe.Encoder(model).encode("Éaux 漢字 ok"), np.int32).tolist()
    d = bpe.Decoder(model, "text")
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "éaux 漢字 ok "
    d = bpe.Decoder(model, "text")
    assert d.feed([model.first[0xE6]]) + d.finish() == "�"


# ------------------------------------------------------------ 4 SimHash

def brute_fingerprint(text, words=3):
    w = words_of((text or "").encode().lower().decode())
    if not w:
        return 0
    runs = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_brute_force(ids, fps):
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = components(len(fps), linked)
    return [min((ids[j] for j in range(len(ids)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def test_simhash_equals_brute_force(spark):
    rows, docs = documents(spark)
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], fps, by_brute_force([i for i, _ in rows], fps)))
    assert Counter((r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(no_documents(spark), "doc_id", "text").count() == 0


def test_simhash_query_on_the_tables(spark):
    docs = sf_rows(f"select doc_id, text from '{SF}/documents.parquet'")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, SF).collect()}
    fps = [brute_fingerprint(t) for _, t in docs]
    want = by_brute_force([i for i, _ in docs], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, want)}


def test_crowded_fingerprints_are_cut_and_compared(spark, monkeypatch):
    """A ball of near fingerprints that many chunks share, beside random ones."""
    monkeypatch.setattr(simhash, "CHUNK", 32)
    r = random.Random(5)
    centre, fps = r.getrandbits(64), set()
    for _ in range(500):
        x = centre
        for b in r.sample(range(64), r.choice([2, 4, 6, 8])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps | {r.getrandbits(64) for _ in range(300)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(x), [signed(x)]) for x in fps], "v long, fp array<long>").repartition(4)
    root = {row.v: row.root for row in simhash.connected_components(simhash.link_edges(classes, 1, 3)).collect()}
    got = [root.get(signed(x), signed(x)) for x in fps]
    want = by_brute_force(list(range(len(fps))), fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


# ------------------------------------------------------------ 5 packing

def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(40):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        hist = [(n * 8, c := r.randint(1, 9), c * r.randint(n * 8 - 7, n * 8)) for n in lengths]
        k = r.randint(1, 5)

        def cost(cuts):
            return sum(c * min(b for b in cuts if b >= n) - t for n, c, t in hist)

        from itertools import combinations
        all_ = [n for n, _, _ in hist]
        best = min(cost((*some, all_[-1])) for m in range(min(k, len(all_))) for some in combinations(all_[:-1], m))
        cuts = packing.optimal_boundaries(hist, k)
        assert len(cuts) <= k and cost(cuts) == best


def test_batches_hold_every_row_once_within_budget(spark):
    rows, docs = documents(spark)
    got = packing.pack(docs, "doc_id", word_count(F.col("text")), buckets=4, budget=512, chunk_rows=7).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(words_of(t))) for i, t in rows)
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r)
    assert len({r.bucket for r in got}) <= 4
    for b in batches.values():
        assert len({(r.bucket, r.padded_tokens, r.batch_docs) for r in b}) == 1
        assert sorted(r.position for r in b) == list(range(len(b))) and len(b) == b[0].batch_docs
        assert len(b) == 1 or len(b) * b[0].padded_tokens <= 512
        assert all(r.padding == r.padded_tokens - r.n_tokens >= 0 for r in b)
    assert packing.pack(no_documents(spark), "doc_id", word_count(F.col("text"))).count() == 0


def test_padding_is_the_least_possible(spark):
    """Against every choice of boundaries; rows over the budget, which are batches alone, are not padded."""
    from itertools import combinations
    fifty = spark.createDataFrame([(i, 9) for i in range(50)], "id int, n int")
    assert sum(r.padding for r in packing.pack(fifty, "id", F.col("n")).collect()) == 0
    r = random.Random(8)
    lengths = [r.choice([3, 9, 10, 11, 40, 41, 77, 100, 333]) for _ in range(200)] + [5000, 7001]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "id int, n int"), "id", F.col("n"), buckets=4, budget=400).collect()
    every = sorted({n for n in lengths if n <= 400})
    best = min(sum(min(b for b in (*some, every[-1]) if b >= n) - n for n in lengths if n <= 400) for some in combinations(every[:-1], 3))
    assert sum(x.padding for x in got) == best
    assert sorted((x.n_tokens, x.padding, x.batch_docs) for x in got if x.n_tokens > 400) == [(5000, 0, 1), (7001, 0, 1)]


def test_length_grid_agrees_with_its_column(spark):
    lengths = [0, 1, 8, 9, 65_535, 65_536, 65_537, 70_001, 1_000_003, 123_456_789]
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", packing._grid(F.col("n"), 8).alias("g"))
    assert [r.g for r in df.orderBy("n").collect()] == [packing.grid_length(n, 8) for n in lengths]


# ------------------------------------------------------------ 6 sharding

def test_shards_fit_and_only_oversized_ones_split(spark):
    rows, docs = documents(spark)
    hot = docs.unionByName(docs.filter("doc_id = 34").withColumn("text", F.lit("hot row " * 20))
                           .withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(200)))))
    limit = 3000
    got = sharding.extendible_shards(hot, "doc_id", F.octet_length("text"), limit).collect()
    assert len(got) == hot.count()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for s, members in shards.items():
        total = sum(m.n_bytes for m in members)
        assert {(m.shard_bytes, m.shard_rows, m.local_depth) for m in members} == {(total, len(members), len(s))}
        assert total <= limit or len(members) == 1
        if s:  # the parent did not fit
            parent = [m for t, ms in shards.items() if t.startswith(s[:-1]) for m in ms]
            assert sum(m.n_bytes for m in parent) > limit and len(parent) > 1
        assert not any(t != s and t.startswith(s) for t in shards)
    assert sharding.extendible_shards(no_documents(spark), "doc_id", F.octet_length("text"), limit).count() == 0
    entries = sharding.directory(sharding.extendible_shards(hot, "doc_id", F.octet_length("text"), limit)).collect()
    assert sum(e.entries for e in entries) <= 2 ** max(e.local_depth for e in entries)  # empty buckets are not listed


# ------------------------------------------------------------ 7 syncmers

def test_syncmers_by_definition():
    text = "the quick brown fox jumps over the lazy dog and the quick brown fox"
    hashes, at = syncmers.closed_syncmers(text, 8, 3)
    one = dict(zip(at.tolist(), hashes.tolist()))
    again = dict(zip(*(x.tolist() for x in reversed(syncmers.closed_syncmers("zzzz " + text, 8, 3)))))
    inner = [p for p in one if p >= 8]
    assert inner and all(again[p + 5] == one[p] for p in inner)  # context-free
    assert max(np.diff(sorted(one))) <= 8 - 3 + 1


def test_fingerprints_of_edits(spark):
    rows, docs = documents(spark)
    got = syncmers.compare_with_edit(docs, "doc_id", "text").collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: (-r[0], -r[1], r[2]))
    want = Counter()
    for (has, i, t), (_, _, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[i if has else None, len(t), sha(t[: len(t) - half] + n[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text_of = {i: t or "" for i, t in rows if i is not None}
    prints = {}
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if r.doc_id is not None:
            assert prints.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
            if r.n_chars == 0:
                assert r.fingerprint == "" and r.near_edited == 1
    assert len(set(prints.values())) >= len(prints) - 1  # "la " 120 and 121 times have the same anchors
    assert syncmers.compare_with_edit(no_documents(spark), "doc_id", "text").count() == 0
    assert [r.fingerprint for r in syncmers.fingerprints(docs.filter("doc_id = 1"), "doc_id", "text").collect()] == [""]


def test_likeness_tells_edits_from_strangers(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 17)
    got = QUERIES["op7_syncmers"](spark, SF).collect()
    docs = dict(sf_rows(f"select doc_id, text from '{SF}/documents.parquet'"))
    assert sorted(r.doc_id for r in got) == sorted(docs)
    ids = sorted(docs, reverse=True)
    nxt = dict(zip(ids, ids[1:] + ids[:1]))
    for r in got:
        t, n = docs[r.doc_id], docs[nxt[r.doc_id]]
        half = len(t) // 2
        assert r.edited_sha256 == sha(t[: len(t) - half] + n[:half])
    assert np.mean([r.near_edited > r.near_next for r in got if docs[r.doc_id] != docs[nxt[r.doc_id]]]) > 0.97


# ------------------------------------------------------------ 8 substrings

def brute_removal(rows, window=20):
    """Rows in order of (id, text hash); rows equal in both are one document."""
    seen, out = {}, {}
    for i, th, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[s : s + window]), (i, th, s))
            if first != (i, th, s):
                gone[s : s + window] = [True] * window
        out[i, th] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def check_removal(spark, docs, rows):
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct()
              .select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted((-(1 << 63) if i is None else i, hashes[t or ""], t) for i, t in {(i, t or "") for i, t in rows})
    brute = brute_removal(order)
    want = Counter((i, *brute[-(1 << 63) if i is None else i, hashes[t or ""]]) for i, t in rows)
    assert Counter(tuple(r) for r in substrings.remove_repeats(docs, "doc_id", "text").collect()) == want


def test_removal_equals_brute_force(spark):
    rows, docs = documents(spark)
    check_removal(spark, docs, rows)
    kept = substrings.strip_repeats(docs, "doc_id", "text")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    untouched = [t for _, t in rows if t and len(words_of(t)) < 20]
    assert set(untouched) <= {r.text for r in kept.collect()}
    assert substrings.remove_repeats(no_documents(spark), "doc_id", "text").count() == 0


def test_substrings_of_rows_repeated_often(spark):
    """Thousands of equal rows that repeat an earlier document carry the spans of one, and lose what one loses."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), *[(2, f"own start {passage}")] * 2000]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    documents_ = substrings._documents(df, "id", "text")
    once = {r.id: sorted(map(tuple, set(r.spans))) for r in substrings.repeated_spans(documents_.distinct()).collect()}
    many = {r.id: r.spans for r in substrings.repeated_spans(documents_).collect()}
    assert {k: sorted(map(tuple, set(v))) for k, v in many.items()} == once and len(many[2]) <= 2 * len(once[2]) and set(many) == {2}
    kept = Counter(tuple(r) for r in substrings.remove_repeats(df, "id", "text").collect())
    assert kept == {(1, 60, 0, passage): 1, (2, 62, 60, "own start"): 2000}


def test_crowded_anchors_deal_single_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", 1)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    rows, docs = documents(spark)
    check_removal(spark, docs, rows)


def test_removal_query_on_the_tables(spark):
    docs = sf_rows(f"select doc_id, text from '{SF}/documents.parquet' order by 1")
    brute = brute_removal([(i, 0, t) for i, t in docs])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substrings"](spark, SF).collect()}
    assert got == {i: (n, g, sha(k)) for (i, _), (n, g, k) in brute.items()}


# ------------------------------------------------------------ 10 n-gram scores

def brute_scores(rows, train):
    tokens = [[*words_of((t or "").encode().lower().decode()), 0] for t in rows]
    c1, c2, c3, h1, h2 = (Counter() for _ in range(5))
    for t, learn in zip(tokens, train):
        if learn:
            c1.update(t)
            p = [1, *t]
            for i, w in enumerate(t):
                c2[p[i], w] += 1
                h1[p[i]] += 1
                if i:
                    c3[p[i - 1], p[i], w] += 1
                    h2[p[i - 1], p[i]] += 1
    n, v = sum(c1.values()), len(c1)
    m1, m2 = ngram_lm.PSEUDO
    out = []
    for t in tokens:
        p, base, full = [1, *t], 0.0, 0.0
        for i, w in enumerate(t):
            q = (c1[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(q)
            q = (c2[p[i], w] + m1 * q) / (h1[p[i]] + m1)
            if i:
                h = h2[p[i - 1], p[i]]
                q = (c3[p[i - 1], p[i], w] + m2 * q) / (h + m2)
            full += math.log10(q)
        out.append((len(t), sum(c1[w] > 0 for w in t), n, base, full))
    return out


def check_scores(got, rows, train):
    want = Counter()
    values = {}
    for (i, _), s in zip(rows, brute_scores([t for _, t in rows], train)):
        want[i, *s[:3]] += 1
        values.setdefault((i, *s[:2]), []).append(s[3:])
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    for r in got:
        assert any(abs(r.base_score - b) < 1e-6 and abs(r.score - f) <= 0.03 * r.n_tokens  # codes of 8 bits
                   for b, f in values[r.doc_id, r.n_tokens, r.n_known])


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(ngram_lm, "BATCH_TOKENS", 500)
    rows, docs = documents(spark)
    got = ngram_lm.score(docs, "doc_id", "text", F.col("doc_id") % 2 == 0).collect()
    check_scores(got, rows, [i is not None and i % 2 == 0 for i, _ in rows])
    nothing = ngram_lm.score(docs, "doc_id", "text", F.lit(False)).collect()
    check_scores(nothing, rows, [False] * len(rows))
    assert ngram_lm.score(no_documents(spark), "doc_id", "text", F.lit(True)).count() == 0


def test_scores_do_not_depend_on_the_shards(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [f"{words[i]} the {r.choice(words)} hot only" for i in range(200)]  # 'hot' has one training successor
    texts += [f"{words[200 + i]} hot {r.choice(words)} the {words[i]}" for i in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = []
    for size in (1 << 20, 300):
        monkeypatch.setattr(ngram_lm, "SHARD_BYTES", size)
        out.append({r.doc_id: r for r in ngram_lm.score(docs, "doc_id", "text", F.col("doc_id") < 200).collect()})
    one, many = out
    check_scores(list(many.values()), rows, [i < 200 for i, _ in rows])
    assert all(abs(one[i].score - many[i].score) < 1e-9 and one[i].n_known == many[i].n_known for i, _ in rows)


def test_scores_query_on_the_tables(spark):
    docs = sf_rows(f"select doc_id, text from '{SF}/documents.parquet'")
    got = QUERIES["op10_lm"](spark, SF).collect()
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs]
    check_scores(got, docs, train)
    assert {r.doc_id: not r.held_out for r in got} == dict(zip([i for i, _ in docs], train))


def test_lm_memory_of_a_batch():
    """A batch's trie takes a bounded number of bytes a token while it is built."""
    import tracemalloc

    r = np.random.default_rng(5)
    words = np.unique(r.integers(0, 1 << 63, 30_000).astype(np.uint64))
    at, sizes = r.integers(0, len(words), 400_000).astype(np.int32), np.full(800, 500)
    tracemalloc.start()
    ngram_lm.BatchTrie(words, at, sizes, 16, words[:20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(at)


def test_lm_scores_do_not_depend_on_the_part_scored_at_a_time(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("a b c d e f g".split()) for _ in range(r.choice([0, 1, 2, 9, 60])))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, None)], "doc_id long, text string").repartition(3)
    out = []
    for some in (1 << 18, 13, 1):
        monkeypatch.setattr(ngram_lm, "SOME_TOKENS", some)
        out.append({x.doc_id: x for x in ngram_lm.score(docs, "doc_id", "text", F.col("doc_id") % 3 > 0).collect()})
    assert len(out[0]) == 201 and out[0] == out[1] == out[2]
