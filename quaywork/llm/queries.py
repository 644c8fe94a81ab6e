"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import crc_fold, pick
from .audit import audit_filters
from .bpe import bpe_round_trip
from .chat import chat_digests, format_chats
from .decontamination import find_leaks
from .embedding_dedup import near_vectors
from .fingerprints import compare_with_edits
from .language_id import identify, train
from .lm_scoring import score_texts
from .merkle import tampered_proofs
from .mixing import mix, words_of
from .ngram_join import ngram_join
from .sharding import shard
from .token_counts import model_pieces, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by an interpolated bigram model of those whose crc32(doc_id) mod 5 is not 1."""
    return score_texts(_table(spark, sf_dir, "documents"), order=2)


OP2_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as x from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a, v b
  where a.vec_id <> b.vec_id and list_inner_product(a.x, b.x) >= 0.95e0 * sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))
), reach as (
  select a as id, b as other from links union select reach.id, links.b from reach join links on reach.other = links.a
), parts as (
  select id, least(id, min(other)) as component_id from reach group by id
), degrees as (
  select a as id, count(*) as n from links group by a
)
select e.vec_id, coalesce(d.n, 0) as n_links, coalesce(p.component_id, e.vec_id) as component_id, coalesce(coalesce(p.component_id, e.vec_id) = e.vec_id, false) as kept
from embeddings e left join parts p on e.vec_id = p.id left join degrees d on e.vec_id = d.id
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings linked by a cosine of 0.95 or more."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document with the 32k pieces and their scores."""
    return token_counts(_table(spark, sf_dir, "documents"), model_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document with the 49k word-end vocabulary."""
    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Weights of the sources in code point order, repeating; and of documents by their quality label (none: 1).
SOURCE_WEIGHTS = [5, 2, 1]
LABEL_WEIGHTS = {0: 0.5, 1: 2.0}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at source weights 5, 2, 1 and 150 % of all words, better documents first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", words_of(F.col("text")).alias("size"))
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    quality = F.when(F.col("label") == 0, LABEL_WEIGHTS[0]).when(F.col("label") == 1, LABEL_WEIGHTS[1]).otherwise(1.0)
    weighted = docs.join(labels, "doc_id", "left").withColumn("quality", quality)
    return mix(weighted, SOURCE_WEIGHTS, quality="quality", size="size").select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = """
with labelled as (
  select doc_id, max(quality) as label from labels where doc_id is not null group by doc_id
), d as (
  select d.doc_id, d.source, cast(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    1 - pow((cast(('0x' || substr(md5('17:' || coalesce(cast(d.doc_id as varchar), '')), 1, 12)) as bigint) + 0.5e0) / 281474976710656e0,
      1 / (case when l.label = 0 then 0.5e0 when l.label = 1 then 2e0 else 1e0 end)) as k
  from documents d left join labelled l on d.doc_id = l.doc_id
), s as (
  select source, cast(sum(size) as double) as source_size,
    case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight
  from d group by source
), f as (
  select source, source_size, weight, 2e0 * source_size as cap, 2e0 * source_size / weight as full_at from s
), v as (
  select *, (1.5e0 * sum(source_size) over () - coalesce(sum(cap) over before, 0e0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0e0)) as level
  from f window before as (order by full_at, source is null, source rows between unbounded preceding and 1 preceding)
), fixed as (
  select level from v where level <= full_at order by full_at, level limit 1
), t as (
  select source, source_size, least(cap, coalesce((select level from fixed) * weight, cap)) as target from v
), e as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t
), r as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.size, d.doc_id rows between unbounded preceding and 1 preceding), 0) as seat
  from d join e on d.source is not distinct from e.source
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(size * (epochs + case when rest > 0 and seat + size / 2e0 <= rest then 1 else 0 end) as bigint) as taken,
  cast(epochs + case when rest > 0 and seat + size / 2e0 <= rest then 1 else 0 end as integer) as copies
from r
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every document and of its text with half of it replaced."""
    return compare_with_edits(_table(spark, sf_dir, "documents"))


#: CRC-32 of a text's UTF-8 bytes, byte by byte with the table of its polynomial.
OP7_SQL = """
with t as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc
), d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as bytes from documents
), c as (
  select doc_id, cast(size as bigint) as size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32 from d, t
), placed as (
  select *, cast(sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as bigint) - size as before, cast(sum(size) over () as bigint) as total from c
), cut as (
  select *, cast(least(16 * (2 * before + size) // (2 * total), 15) as integer) as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by before) - 1 as slot, cast(null as integer) as grown_shard from cut
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes."""
    return shard(_table(spark, sf_dir, "documents"), 16)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("held_out", crc_fold("doc_id", 4) == 2)
    found = identify(docs, train(docs.where("not held_out")), ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", F.col("bits").alias("bits_per_char"))


#: A conversation whose texts hold the template's own marks.
MARKED_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back, of all conversations and one more after formatting with loss masks."""
    rows = pick(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.createDataFrame(MARKED_CHAT, "conv_id long, turn long, role string, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat_digests(format_chats(rows.unionByName(more), ranks), ranks)


#: Escaping puts one character into each control string; turns that tie in order and role are put in order by text.
OP9_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, n, who, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(n, who)
), sized as (
  select *, len(text) + len(regexp_extract_all(text, '#\\\\*## (?:System|User|Assistant|Other):|<\\\\*/(?:role|turn)>')) as text_chars,
    len(role) + len(regexp_extract_all(role, '#\\\\*## (?:System|User|Assistant|Other):|<\\\\*/(?:role|turn)>')) as role_chars from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_chars + 8 + case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 else 11 + role_chars + 7 end) as bigint) as formatted_chars
from sized group by conv_id
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a Jaccard likeness of 0.85 or more."""
    return ngram_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


OP10_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) end) as grams from w
), g as (
  select doc_id, len(grams) as n, unnest(grams) as gram from s
), shared as (
  select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2, 3, 4
), links as (
  select a, b from shared where 100 * common >= 85 * (n + m - common)
), reach as (
  select a as id, b as other from links union select reach.id, links.b from reach join links on reach.other = links.a
), parts as (
  select id, least(id, min(other)) as component_id from reach group by id
)
select s.doc_id, cast(len(grams) as bigint) as n_shingles, coalesce(p.component_id, s.doc_id) as component_id from s left join parts p on s.doc_id = p.id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it verifies after some were tampered with."""
    return tampered_proofs(_table(spark, sf_dir, "documents"))


#: CRC-32 as in OP7_SQL; nodes of all levels, then each leaf's run on each level, then the fold of each leaf by levels.
OP11_SQL = """
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc
), d as (
  select doc_id, source, lang, n_chars, text, case when text is not null then replace(text, chr(10), '') end as bare,
    list_transform(regexp_extract_all(hex(encode(cast(doc_id as varchar))), '..'), lambda h: cast('0x' || h as bigint)) as bytes from documents
), f as (
  select doc_id, source, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as front, text,
    case when xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) % 2 = 0 then bare else text end as other from d, t
), h as (
  select doc_id, source, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(front || coalesce(octet_length(encode(other)) || ':' || other, '-')) as tampered from f
), leaves as (
  select *, dense_rank() over (order by source nulls first) as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from h
), nodes(level, tree, i, n, digest) as (
  select 0, tree, i, n, leaf from leaves
  union all
  select level + 1, tree, i // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' order by i)) from nodes where n > 1 group by level, tree, i // 3
), tops as (
  select tree, level as height, digest as subroot, tree - 1 as i, count(*) over () as n from nodes where n = 1
), upper(level, i, n, digest) as (
  select 0, i, n, subroot from tops
  union all
  select level + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' order by i)) from upper where n > 1 group by level, i // 3
), top as (
  select level as height, digest as root from upper where n = 1
), whole as (
  select level, tree, i // 3 as run, i, digest from nodes where n > 1
), runs as (
  select l.tree, l.i as leaf_i, w.level, coalesce(string_agg(w.digest, '' order by w.i) filter (w.i < l.i // power(3, w.level)::bigint), '') as before,
    coalesce(string_agg(w.digest, '' order by w.i) filter (w.i > l.i // power(3, w.level)::bigint), '') as after
  from leaves l join whole w on w.tree = l.tree and w.run = l.i // power(3, w.level + 1)::bigint group by all
), high as (
  select s.tree, s.height + w.level as level, coalesce(string_agg(w.digest, '' order by w.i) filter (w.i < s.i // power(3, w.level)::bigint), '') as before,
    coalesce(string_agg(w.digest, '' order by w.i) filter (w.i > s.i // power(3, w.level)::bigint), '') as after
  from tops s join (select * from upper where n > 1) w on w.i // 3 = s.i // power(3, w.level + 1)::bigint group by s.tree, s.height, s.i, w.level
), steps as (
  select tree, leaf_i, level, before, after from runs union all select h.tree, l.i, h.level, h.before, h.after from high h join leaves l on h.tree = l.tree
), fold(tree, i, level, digest) as (
  select tree, i, 0, tampered from leaves
  union all
  select f.tree, f.i, f.level + 1, sha256(s.before || f.digest || s.after) from fold f join steps s on s.tree = f.tree and s.leaf_i = f.i and s.level = f.level
), ended as (
  select tree, i, arg_max(digest, level) as folded_root from fold group by tree, i
), proofs as (
  select tree, leaf_i, sha256(string_agg(before || after, '' order by level)) as proof_sha256 from steps group by tree, leaf_i
)
select l.doc_id, l.leaf, s.subroot, top.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = top.root as verified
from leaves l join tops s on s.tree = l.tree cross join top join ended e on e.tree = l.tree and e.i = l.i left join proofs p on p.tree = l.tree and p.leaf_i = l.i
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What filters A to E remove from the documents of each language in all 120 orders, and their Shapley shares."""
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Every order is applied step by step to every document.
OP12_SQL = """
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as words from documents
), firsts as (
  select text, min(doc_id) as first from d group by text
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, map {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * len(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > firsts.first, false)} as fails
  from d join firsts using (text) left join l on l.doc_id = d.doc_id
), masks as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails
), orders(filter_order) as (
  select '' union all select filter_order || c from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(c) where len(filter_order) < 5 and not contains(filter_order, c)
), told as (
  select *, list_filter(range(1, 6), lambda k: fails[filter_order[k]]) as failing from masks, orders where len(filter_order) = 5
), steps as (
  select part, filter_order, step, filter_order[step] as name,
    sum(n) filter (len(failing) = 0 or failing[1] > step) as kept, sum(n) filter (failing[1] = step) as removed,
    sum(n) filter (list_contains(failing, step) and failing[1] < step) as redundant, sum(n) filter (len(failing) = 1 and failing[1] = step) as unique_fails,
    sum(good) filter (failing[1] = step) as good_lost, sum(toxic) filter (failing[1] = step) as toxic_lost
  from told, range(1, 6) r(step) group by all
)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, name) as bigint) as shapley
from steps
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten words of benchmark items, and the items hit."""
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (sum, s) -> sum + s.end - s.start)")
    told = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return told.withColumn("contaminated", F.col("n_hit") > 0)


OP13_SQL = """
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), b as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), windows as (
  select distinct item, least(len(words), 10) as n, unnest(list_transform(range(1, greatest(len(words) - 8, 2)), lambda i: array_to_string(words[i : i + 9], ' '))) as gram from b where len(words) > 0
), grams as (
  select row, s.n, unnest(range(1, len(words) - s.n + 2)) as i, unnest(list_transform(range(1, len(words) - s.n + 2), lambda i: array_to_string(words[i : i + s.n - 1], ' '))) as gram
  from d, (select distinct n from windows) s where len(words) >= s.n
), hits as (
  select g.row, g.i, g.n, w.item from grams g join windows w on w.n = g.n and w.gram = g.gram
), covered as (
  select row, count(*) as n_hit from (select distinct row, unnest(range(i, i + n)) as at from hits) group by row
), named as (
  select row, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row, item from hits) group by row
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (row) left join named using (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_bpe_encoding": op4_bpe_encoding,
        "op5_mixing": op5_mixing,
        "op6_fingerprints": op6_fingerprints,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_chat_format": op9_chat_format,
        "op10_ngram_join": op10_ngram_join,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_filter_audit": op12_filter_audit,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2_SQL,
        "op5_mixing": OP5_SQL,
        "op7_sharding": OP7_SQL,
        "op9_chat_format": OP9_SQL,
        "op10_ngram_join": OP10_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_decontamination": OP13_SQL,
    }
