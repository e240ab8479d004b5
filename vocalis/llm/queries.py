"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.bpe import bpe_digests
from vocalis.llm.embeddings import near_embeddings
from vocalis.llm.fim import fill_in_middle, restored
from vocalis.llm.fingerprints import fingerprint_documents
from vocalis.llm.html import extract_main_text
from vocalis.llm.jaccard import jaccard_components
from vocalis.llm.licenses import scan_licences
from vocalis.llm.linededup import drop_repeated_lines
from vocalis.llm.packing import pack_sequences
from vocalis.llm.substring import near_duplicate_passages
from vocalis.llm.tokenfile import token_file_digests
from vocalis.llm.toxicity import toxicity_report
from vocalis.llm.turnrepair import damage_turns, repair_conversations

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document: how many, their words, and the length of what is kept."""
    found = near_duplicate_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.aggregate("repeated", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.size("repeated").cast("long").alias("n_passages"), words.alias("repeated_words"), "repeated", F.length("kept_text").cast("long").alias("kept_chars"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_read(spark, sf_dir, "documents"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_read(spark, sf_dir, "embeddings"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as units, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
f as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:n], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from f"""


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = """
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select row, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
often as (select key from k where length(key) >= 1 group by key having count(distinct row) >= 10),
j as (select k.*, often.key is not null as gone from k left join often on k.key = often.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by row"""


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = repair_conversations(damage_turns(_read(spark, sf_dir, "conversations"))).report
    return report.withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_packing, op3_html, op4_licenses, op5_bpe, op6_substring, op7_jaccard, op8_fingerprints, op9_tokenfile, op10_embeddings, op11_fim, op12_lines, op13_turns)
}
#: The others can't be stated in SQL in full; each is tested against a brute-force version in tests/llm.
ORACLE_SQL: dict[str, str] = {"op11_fim": OP11_SQL, "op12_lines": OP12_SQL}
