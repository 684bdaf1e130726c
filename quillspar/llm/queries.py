"""The queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textops import crc32_text


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import power_of_two_pieces

    return power_of_two_pieces(table(spark, sf_dir, "documents"), word_tokenizer())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: A word is lower-cased from A-Z only, so the alphabet is put through translate.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as g
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select dw.doc_id, dw.k, dw.i, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, k, i from m)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .omh import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(F.pmod(crc32_text("doc_id"), F.lit(3)) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (F.pmod(crc32_text("doc_id"), F.lit(3)) == 1).alias("held_out"), F.col("best").alias("lang_pred"), "score", "rejected")


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import REJECT_FROM, learn, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc32_text("doc_id"), F.lit(3)) == 1
    model = learn(docs, labels.where(~held_out))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"), "n_words", "ordinary_log", "toxic_log", "log_ratio")


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


OP6_SQL = """
with t as (select conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
p as (select distinct conv_id as c, speaker as perspective from t where speaker <> 'system'),
v as (select conv_id, perspective, turn, speaker, body,
        case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as chat_role
      from t join p on t.conv_id is not distinct from p.c),
h as (select *, case when chat_role = 'user' then '<|user name=' || speaker || '|>' || chr(10) else '<|' || chat_role || '|>' || chr(10) end as head from v),
s as (select *, length(head) + length(body) + 8 as size from h),
o as (select *, row_number() over w as seq, cast(sum(size) over (w rows unbounded preceding) as bigint) as char_end from s
      window w as (partition by conv_id, perspective order by turn nulls first, speaker, body))
select conv_id, perspective, seq, turn, speaker, chat_role, head || body || '<|end|>' || chr(10) as segment, char_end - size as char_start, char_end,
    case when chat_role = 'assistant' then char_end - size + length(head) else 0 end as mask_start,
    case when chat_role = 'assistant' then char_end - 1 else 0 end as mask_end
from o
"""


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, joined, spans

    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined(True)), 256).alias("base_sha256"), F.expr(joined()).alias("spans"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op5_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_trie import build, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_text("doc_id"), F.lit(7)) == 2
    trie = build(docs.where(~held_out))
    return score(docs, trie).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_order_minhash": op1_order_minhash, "op2_decontamination": op2_decontamination, "op3_packing": op3_packing, "op4_kneser_ney_toxicity": op4_kneser_ney_toxicity, "op5_ngram_trie": op5_ngram_trie, "op6_perspective_rotation": op6_perspective_rotation, "op7_repeated_bytes": op7_repeated_bytes, "op8_compression_langid": op8_compression_langid, "op9_weak_supervision_pii": op9_weak_supervision_pii, "op10_jaccard_join": op10_jaccard_join}


OP10_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 4 then [array_to_string(list_slice(w, i, i + 3), ' ') for i in range(1, len(w) - 2)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
e as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * both_have >= 85 * (len(x.s) + len(y.s) - both_have)),
ways as (select a, b from l union all select b, a from l),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, ways.b from reach join ways on reach.b = ways.a),
least as (select a, min(b) as component_id from reach group by 1)
select s.doc_id, cast(len(s) as bigint) as n_shingles, component_id from s join least on least.a = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_perspective_rotation": OP6_SQL, "op10_jaccard_join": OP10_SQL}
