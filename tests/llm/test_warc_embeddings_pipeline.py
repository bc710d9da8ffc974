import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF, components, sf_rows
from pyspark.sql import functions as F

import corpus_pipeline
from mercata.llm import nndescent, warc
from mercata.llm.eliasfano import EliasFano, Trie
from mercata.llm.fmindex import FMIndex, repeated_windows
from mercata.llm.queries import ORACLES, QUERIES


# ------------------------------------------------------------ 3 WARC

def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u\r\nv", "é\r\n\r\nWARC/1.1\r\n\r\n漢"),
            (6, "u", "x" * 3_000_000), (6, "u", "x" * 3_000_000), (None, "n", "nul"), (7, "k", "same"), (7, "k", "same"), (8, "s", "other")]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, key int").repartition(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, "page_id", "url", "html")
    got = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    top = {}
    for i, _, h in rows:
        d = digest(h)
        top[d] = max(top.get(d, -1), -1 if i is None else i)
    want = Counter()
    for i, u, h in rows:
        d = digest(h)
        first = None if top[d] == -1 else top[d]
        kind = "response" if i == first else "revisit"
        want[str(i) if i is not None else "null", kind, (u or "").replace("\r", " ").replace("\n", " "), d, len((h or "").encode()),
             None if kind == "response" else str(first)] += 1
    assert Counter((r.name, r.record_type, r.url, r.digest, r.n_bytes, r.refers_name) for r in got) == want
    small = str(tmp_path / "small")
    warc.write_archives(pages, small, "page_id", "url", "html", min_bytes=5)
    kinds = Counter((r.digest, r.record_type) for r in warc.read_archives(spark, small).collect())
    assert kinds[digest("same"), "response"] == 5 and kinds[digest("same"), "revisit"] == 0
    empty = str(tmp_path / "empty")
    warc.write_archives(pages.limit(0), empty, "page_id", "url", "html")
    assert warc.resolve_revisits(warc.read_archives(spark, empty)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert df.count() > 0


# ------------------------------------------------------------ 9 embeddings

def brute_links(rows, threshold=0.9):
    ok = [r is not None and len(r) == 6 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    x = np.array([r if o else [0.0] * 6 for r, o in zip(rows, ok)], np.float32).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = (x @ x.T >= threshold) & np.array(ok)[:, None] & np.array(ok)[None, :]
    np.fill_diagonal(s, False)
    return s


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=6)
    vectors = [rng.normal(size=6).tolist() for _ in range(300)]
    vectors += [(centre + 0.1 * rng.normal(size=6)).tolist() for _ in range(80)]  # more links than a list holds
    vectors += [centre.tolist()] * 30 + [(3 * centre).tolist(), (1e-30 * centre).tolist()]
    odd = [None, [], [0.0] * 6, [None, *[1.0] * 5], [float("nan"), *[1.0] * 5], [float("inf"), *[1.0] * 5], [1.0, 2.0]]
    vectors += odd + odd
    rows = [(3 * i + 1, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, vec string, sim double").repartition(3)
    got = {r.vec_id: r for r in nndescent.near_duplicates(df, "vec_id", "embedding").collect()}
    links = brute_links(vectors)
    roots = components(len(vectors), np.argwhere(links).tolist())
    for k, (i, _) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k].sum(), rows[roots[k]][0], roots[k] == k)
    assert nndescent.near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0
    lone = nndescent.near_duplicates(df.filter(F.size("embedding") == 2), "vec_id", "embedding").collect()
    assert sorted(r.n_links for r in lone) == [1, 1]  # here two is the commonest length
    nameless = nndescent.near_duplicates(df.limit(5).withColumn("vec_id", F.lit(None).cast("long")), "vec_id", "embedding").collect()
    assert len(nameless) == 5 and not any(r.kept for r in nameless)


def clumps(seed=6, n=12, each=14, d=24):
    """Clumps of nearly equal vectors: more than a list holds at 0.99 inside, about 0.92 from clump to clump of one group."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = [rng.normal(size=d) for _ in range(60)]
    for _ in range(3):
        centre = unit(rng.normal(size=d))
        for _ in range(n):
            own = unit(centre + 0.295 * unit(rng.normal(size=d)))
            out += [unit(own + 0.07 * unit(rng.normal(size=d))) for _ in range(each)]
    return [x.tolist() for x in out]


@pytest.mark.parametrize("widenings", [nndescent.WIDENINGS, -1])  # -1: no lists pass, all vectors are compared in pieces
def test_full_lists_hide_no_links(spark, monkeypatch, widenings):
    if widenings < 0:
        monkeypatch.setattr(nndescent, "RECALL", 2.0)
        monkeypatch.setattr(nndescent, "WIDENINGS", 0)
    vectors = clumps()
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    roots = components(len(vectors), np.argwhere(links).tolist())
    assert len(set(roots[60:])) <= 6
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in nndescent.near_duplicates(df, "vec_id", "embedding").collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(vectors))] == [(links[i].sum(), roots[i]) for i in range(len(vectors))]


def test_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = sf_rows(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1")
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in QUERIES["op9_nndescent"](spark, sf).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()


# ------------------------------------------------------------ indexes

def test_elias_fano_by_search():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1, 2**63), (7, 2**64 - 1), (1000, 100), (5000, 2**40), (70_000, 2**62)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        seq, _ = EliasFano.read(np.concatenate(EliasFano.parts(v)), 0)
        assert (seq[np.arange(n)] == v).all()
        x = np.concatenate([rng.choice(v, 100), rng.integers(0, top, 100, dtype=np.uint64)])
        a = rng.integers(0, n + 1, len(x))
        b = np.maximum(a, rng.integers(0, n + 1, len(x)))
        at, found = seq.successor(x, a, b)
        for k in range(len(x)):
            w = a[k] + np.searchsorted(v[a[k] : b[k]], x[k])
            assert at[k] == w and found[k] == (w < b[k] and v[w] == x[k])


def test_trie_finds_exactly_its_paths():
    rng = np.random.default_rng(2)
    paths = np.unique(rng.integers(0, 30, (900, 2)).astype(np.uint64), axis=0)
    first, where = np.unique(paths[:, 0], return_inverse=True)
    none = [np.zeros(len(first), np.uint8), np.zeros(len(paths), np.uint8)]
    trie = Trie(Trie.build([first, paths[:, 1]], [np.bincount(where)], np.arange(len(first)), none, none))
    ask = np.array([(a, b) for a in range(35) for b in range(35)], np.uint64)
    got = trie.find(1, trie.find(0, None, ask[:, 0]), ask[:, 1])
    known = {tuple(p): i for i, p in enumerate(paths.tolist())}
    assert got.tolist() == [known.get(tuple(p), -1) for p in ask.tolist()]


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(text, 5, 6)
    for _ in range(200):
        a = rng.integers(0, 390)
        pattern = text[a : a + rng.integers(1, 7)] if rng.random() < 0.7 else rng.integers(1, 5, 6)
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        n = sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))
        assert hi[0] - lo[0] == n


def test_repeated_windows_by_brute_force():
    rng = np.random.default_rng(5)
    segments = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint32) for _ in range(40)]
    segment, offset, lowest, begins = repeated_windows(segments, 4, block=50)
    keys = np.full(sum(len(s) + 1 for s in segments) + 1, 1 << 40)
    seen = {}
    for s, x in enumerate(segments):
        keys[begins[s] : begins[s] + len(x)] = s * 1000 + np.arange(len(x))
        for k in range(len(x) - 3):
            seen.setdefault(x[k : k + 4].tobytes(), []).append((s, k))
    want = {p: at[0][0] * 1000 + at[0][1] for at in seen.values() if len(at) > 1 for p in at}
    assert dict(zip(zip(segment.tolist(), offset.tolist()), lowest(keys).tolist())) == want


# ------------------------------------------------------------ the pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_table(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "packing"]
    texts = [r.text for r in out["near_dedup"].collect()]
    assert 0 < len(texts) < out["quality"].count() < before
    assert len(set(texts)) == len(texts)
    windows = Counter(tuple(w[i : i + 20]) for r in out["substring_dedup"].collect() for w in [r.text.split()]
                      for i in range(len(w) - 19) if r.n_chars == len(r.text))
    whole = Counter(t for t, n in windows.items() if n > 1)
    assert sum(whole.values()) <= 0.001 * sum(windows.values())  # seams between kept pieces may meet again
    ids = [r.doc_id for r in out["packing"].collect()]
    assert sorted(ids) == sorted(r.doc_id for r in out["substring_dedup"].collect())
    assert corpus_pipeline.run(spark, SF).count() == len(ids)


def _stage_input(spark):
    """The smallest documents table with nulls, empty and very long texts, repeated rows and a clashing column or two."""
    from llm.helpers import texts
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(100_000 + i, t, "en", "s", None) for i, t in enumerate(texts())]
    odd += [odd[10], odd[10], (None, "no id " * 30, None, None, 3), (None, None, None, None, None), (7_000_000, "w " * 60_000, "en", "s", 1)]
    clash = spark.createDataFrame([(*r, 1, "x", 0.5) for r in given + odd], "doc_id long, text string, lang string, source string, n_chars long, "
                                  "id long, fp string, score double")
    return given + odd, clash.repartition(5)


def test_near_dedup_stage_equals_brute_force(spark):
    """Fingerprints by the contract's words, all pairs compared: what stays is each component's smallest id."""
    from llm.test_text_operators import brute_fingerprint, by_brute_force
    rows, docs = _stage_input(spark)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    keyed = list({r[0]: r for r in rows if r[0] is not None}.values())
    names = by_brute_force([r[0] for r in keyed], [brute_fingerprint(r[1]) for r in keyed])
    want = sorted({names[k] for k in names} if isinstance(names, dict) else set(names))
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 2


def test_quality_stage_follows_the_scores(spark):
    """What stays is what the scores of the classifier's own query say, row by row; odd rows have a result."""
    from mercata.llm import quality
    rows, docs = _stage_input(spark)
    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.columns == docs.columns
    scores = {}
    for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "quality").collect():
        scores.setdefault(r.doc_id, []).append(r.score >= quality.THRESHOLD)
    kept = Counter(r.doc_id for r in out.collect())
    assert kept == Counter({k: sum(v) for k, v in scores.items() if sum(v)})
    assert 0 < sum(kept.values()) < len(rows)


def test_stages_on_odd_rows_and_empty_tables(spark):
    rows, docs = _stage_input(spark)
    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    short = Counter(r[:2] for r in rows if r[1] is None or len(r[1].split()) < 20)
    assert short == Counter((r.doc_id, r.text) for r in cut.collect() if (r.doc_id, r.text) in short)
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)
    assert all(0 <= r.padding for r in packed)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
