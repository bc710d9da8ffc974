"""Registered queries of the training-data operators and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.llm import bpe, conversations, merkle, ngram_lm, nndescent, packing, quality, secrets, sharding, simhash, substrings, syncmers, warc
from mercata.llm.text import word_count
from mercata.session import ensure_checkpoint_dir
from mercata.sources.tables import read_table

SHARD_BYTES = 1 << 20


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                             "doc_id", "text", "quality")
    return found.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), "doc_id", "text", path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/mercata-warc-{uuid.uuid4().hex}"
    warc.write_archives(read_table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.resolve_revisits(warc.read_archives(spark, path))
    as_id = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return found.select(as_id("name").alias("page_id"), F.col("n_bytes").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), "record_type", as_id("refers_name").alias("refers_to"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), "doc_id", word_count(F.col("text")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(read_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edit(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(read_table(spark, sf_dir, "documents"), "doc_id", "text", ~quality.held_out(F.col("doc_id"), 10))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    report, lines = conversations.repair(conversations.damage(given, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text")
    return conversations.with_digests(report, lines, given.select("conv_id")).withColumnRenamed("conv", "conv_id")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(read_table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"],
                            {"text": F.when(hit, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_quality, op2_bpe, op3_warc, op4_simhash, op5_packing, op6_sharding,
                                op7_syncmers, op8_substrings, op9_nndescent, op10_lm, op11_repair, op12_secrets,
                                op13_merkle)}


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, eight rounds a byte."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint)), "
            "lambda c, b: list_reduce([0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), "
            "4294967295)")


ORACLES = {
    # Base32 of SHA-1: 20 bits (5 hex digits) at a time, 4 characters each.
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as hex from p),
e as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + cast((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31 as integer), 1)), '') as payload_digest from d),
m as (select *, max(page_id) over (partition by payload_digest) as original from e)
select page_id, payload_bytes, payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type,
       case when page_id <> original then original end as refers_to from m""",
    "op6_sharding": f"""
with r as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
             lpad(bin(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint)), 60, '0') as bits from documents),
t as (select substr(bits, 1, d) as shard, cast(d as integer) as local_depth, cast(sum(n_bytes) as bigint) as shard_bytes, count(*) as shard_rows
      from r, range(0, 41) x(d) group by 1, 2),
ok as (select * from t where shard_bytes <= {SHARD_BYTES} or shard_rows = 1)
select r.doc_id, r.n_bytes, ok.shard, ok.local_depth, ok.shard_bytes, ok.shard_rows from r join ok on ok.shard = substr(r.bits, 1, ok.local_depth)
qualify row_number() over (partition by r.doc_id order by ok.local_depth) = 1""",
    "op8_substrings": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
starts as (select doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i : i + 19], ' '))) as words,
             unnest(range(1, len(ws) - 18)) as s from w where len(ws) >= 20),
again as (select doc_id, s from starts qualify row_number() over (partition by words order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as j from again),
left_over as (select doc_id, string_agg(word, ' ' order by j) as kept, count(*) as n
              from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w) anti join gone using (doc_id, j)
              group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join left_over using (doc_id)""",
    "op9_nndescent": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
          where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select reach.vec_id, links.b from reach join links on reach.other = links.a),
named as (select vec_id, min(other) as component_id from reach group by vec_id),
counted as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from named left join counted using (vec_id)""",
    # Turn by turn from the front: the best repair of the turns so far for each role put out last (0 nothing, 1 system, 2 user,
    # 3 assistant). Up to two inserts may stand in front of a turn; more never pay.
    "op11_repair": """
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    """ + _crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')") + """ % 20 as how from conversations),
damaged as (
  select conv_id, turn, case when how = 4 then 'user' else role end as role,
    case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when how = 3 then [0, 1] else [0] end) as copy from c where how <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, count(*) over (partition by conv_id) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from damaged),
t as (
  select *, substr(role, 1, 1) as s, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as p,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault from placed),
pre(q, cost, audit, lines, q2) as (
  select q, 0, '', []::varchar[], q from range(4) x(q)
  union all values (0, 5, 'I', ['user:'], 2), (1, 5, 'I', ['user:'], 2), (3, 5, 'I', ['user:'], 2), (2, 5, 'I', ['assistant:'], 3),
    (0, 10, 'II', ['user:', 'assistant:'], 3), (1, 10, 'II', ['user:', 'assistant:'], 3), (3, 10, 'II', ['user:', 'assistant:'], 3),
    (2, 10, 'II', ['assistant:', 'user:'], 2)),
best as (
  select distinct conv_id, 0::bigint as i, 0::bigint as q, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} as b from t
  union all
  select conv_id, i, q, min(b) from (
    select best.conv_id, t.i, cast(case e when 'D' then q2 when 'R' then if(q2 = 2, 3, 2) else case s when 's' then 1 when 'u' then 2 else 3 end end as bigint) as q,
      {'cost': cast(b.cost + pre.cost + case e when 'D' then 2 else if(e = 'R', 1, 0) + if(fault = 'truncated', 5, 0) end as bigint),
       'audit': b.audit || pre.audit || e,
       'lines': list_concat(list_concat(b.lines, pre.lines), case e when 'D' then []::varchar[]
          when 'R' then [if(q2 = 2, 'assistant:', 'user:') || text] else [role || ':' || text] end)} as b
    from best join t on t.conv_id is not distinct from best.conv_id and t.i = best.i + 1 join pre on pre.q = best.q, (values ('D'), ('R'), ('K')) edits(e)
    where e = 'D' or (fault not in ('blank', 'duplicate') and (e = 'R' or (s = 's' and q2 = 0) or (s = 'u' and q2 <> 2) or (s = 'a' and q2 = 2))))
  group by conv_id, i, q),
closed as (
  select best.conv_id, min({'cost': cast(b.cost + case q when 1 then 10 when 2 then 5 else 0 end as bigint),
    'audit': b.audit || case q when 1 then 'II' when 2 then 'I' else '' end,
    'lines': list_concat(b.lines, case q when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else []::varchar[] end)}) as b
  from best join (select conv_id, max(i) as n from t group by conv_id) m on m.conv_id is not distinct from best.conv_id and best.i = m.n
  group by best.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (p is not null and p || s not in ('su', 'ua', 'au')) as illegal from t group by conv_id)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit,
  sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted k on k.conv_id is not distinct from o.conv_id
  left join closed l on l.conv_id is not distinct from o.conv_id""",
    # The trees grow level by level; a node's siblings are its run's
    # others, and a leaf is folded with them up to its subroot and on to the root.
    "op13_merkle": """
with recursive d as (
  select *, doc_id is not null and """ + _crc32("cast(doc_id as varchar)") + """ % 3 = 0 as hit from documents),
e as (
  select doc_id, coalesce('=' || lang, '') as tree,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head, text,
    case when hit then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as tampered from d),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) as other from e),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves),
nodes as (
  select tree, 0 as level, i, n, leaf as h from placed
  union all
  select tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by tree, level, i // 8, n),
subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, i, n, subroot as h from subroots
  union all
  select level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 8, n),
sib as (
  select a.tree, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l,
    coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.i // 8 = b.i // 8 where a.n > 1 group by a.tree, a.level, a.i),
top_sib as (
  select a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l,
    coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from tops a join tops b on a.level = b.level and a.i // 8 = b.i // 8 where a.n > 1 group by a.level, a.i),
up as (
  select tree, i as leaf_i, 0 as level, i, other as h, '' as proof from placed
  union all
  select up.tree, leaf_i, up.level + 1, up.i // 8, sha256(l || up.h || r), proof || l || r from up join sib using (tree, level, i)),
ended as (
  select up.* from up join nodes using (tree, level, i) where nodes.n = 1),
up_top as (
  select tree, leaf_i, 0 as level, subroots.i, h, proof from ended join subroots using (tree)
  union all
  select tree, leaf_i, level + 1, i // 8, sha256(l || h || r), proof || l || r from up_top join top_sib using (level, i))
select p.doc_id, p.leaf, s.subroot, tops.h as root, sha256(u.proof) as proof_sha256, u.h as folded_root, u.h = tops.h as verified
from placed p join subroots s on s.tree = p.tree join up_top u on u.tree = p.tree and u.leaf_i = p.i join tops on tops.n = 1 and tops.level = u.level""",
}
