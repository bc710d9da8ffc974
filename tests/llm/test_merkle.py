"""The Merkle manifest against a plain tree in Python, and the places of its log."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mercata.llm import merkle
from mercata.llm.queries import QUERIES

from llm.helpers import CLASH, SF, documents, no_documents, sf_rows


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i: i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = range(i - i % 8, min(i - i % 8 + 8, len(nodes)))
        out.append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        i //= 8
    return out


def _brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); the contract, as plainly as can be."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, _leaf(*r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = _levels([leaf for _, leaf in by_lang[lang]])
    top = _levels([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for i, (r, leaf) in enumerate(by_lang[lang]):
            sib = _siblings(trees[lang], i) + _siblings(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = _leaf(*r[:4], text)
            for left, right in sib:
                h = _h(*left, h, *right)
            out.append((r[0], leaf, trees[lang][-1][0], root, _h(*[x for a, b in sib for x in [*a, *b]]), h, h == root))
    return out


def _apply(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(df, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"],
                            {"text": F.when(hit, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root",
                                                  "verified").collect()), key=repr)


def test_query_equals_plain_trees(spark):
    got = sorted((tuple(r) for r in QUERIES["op13_merkle"](spark, SF).collect()), key=repr)
    assert got == sorted(_brute(sf_rows(f"select doc_id, source, lang, n_chars, text from '{SF}/documents.parquet'")), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows, df = documents(spark)
    df = df.withColumn("lang", F.expr("case pmod(length(text), 3) when 0 then 'en' when 1 then '' end"))
    plain = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _apply(df) == sorted(_brute(plain), key=repr)
    empty = spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    assert _apply(empty) == []


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 4096, 4097, 9000])
def test_log_is_dense_and_in_completion_order(spark, n, monkeypatch):
    digests = [_h(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([("t", i, d) for i, d in enumerate(digests)], "tree string, at long, digest string")
    tiers = merkle.append_log(leaves)
    entries = sorted(tuple(r) for r in merkle.log_entries(tiers).collect())
    levels = _levels(digests)
    assert [e[1] for e in entries] == list(range(sum(map(len, levels))))
    assert {(e[2], e[3]): e[4] for e in entries} == {(k, i): d for k, x in enumerate(levels) for i, d in enumerate(x)}
    at = {(e[2], e[3]): e[1] for e in entries}
    assert all(at[k - 1, min(8 * i + 7, len(levels[k - 1]) - 1)] < at[k, i] for k in range(1, len(levels)) for i in range(len(levels[k])))
    assert [r.digest for r in merkle.roots(tiers).collect()] == [levels[-1][0]]


def test_places_without_the_tree():
    r = random.Random(3)
    for n in [*range(1, 150), *(r.randint(150, 30_000) for _ in range(10))]:
        seen, top = [], merkle.height(n)
        for level in range(top + 1):
            seen += [merkle.log_position(level, i, n) for i in range(-(-n // 8 ** level))]
        assert sorted(seen) == list(range(merkle.log_length(n, top)))


def test_trees_of_three_tiers_prove_their_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 9)).alias("lang"),
                                 F.lit("s").alias("source"), F.lit(4).alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    plain = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _apply(df) == sorted(_brute(plain), key=repr)
