"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.operators import alignment as A
from vocalis.operators import corpus as C
from vocalis.operators import decoding as D
from vocalis.operators import transcripts as G
from vocalis.operators.models import compression_ratio
from vocalis.plans.tables import read, spread
from vocalis.sources import formats as S

LETTERS = "abcdefghijklmnopqrstuvwxyz'"
SQL_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(expr: str, name: str) -> str:
    c = T.cleaner(name)
    if c.lower_first:
        expr = f"(lower(substr({expr},1,1)) || substr({expr},2))"
    for old, new in c.groups.items():
        expr = f"replace({expr},{quote(old)},{quote(new)})"
    if c.letters:
        expr = f"translate({expr},{quote(''.join(c.letters))},{quote(''.join(c.letters.values()))})"
    return f"regexp_replace({expr},'{SQL_SPACES}',' ','g')"


def vocabulary_sql(expr: str, name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({clean_sql(expr, name)},' ')),'{SQL_SPACES}',' ','g'),{quote('[^' + LETTERS + ' ]')},'','g'),' ')"


def _cleaned(spark, d):
    """Cleaned texts of ten letters and more; one array per row, so that the cleaning is evaluated once and not again in a filter."""
    docs = spread(read(spark, d, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.explode(F.filter(F.array(T.clean_for_vocabulary(F.col("text"), "en", LETTERS)), lambda t: F.length(t) > 9)).alias("t"))


CLEANED = f"(select doc_id, lang, {vocabulary_sql('text', 'en')} as t from documents where length({vocabulary_sql('text', 'en')}) > 9)"
WORDS = f"(select unnest(string_split(t,' ')) as word from {CLEANED})"

QUERIES = {
    "lm_vocab_topk": lambda s, d: C.top_words(C.token_counts(_cleaned(s, d), F.col("t")), 50),
    "word_counts": lambda s, d: C.token_counts(_cleaned(s, d), F.col("t")),
    "ngram_counts": lambda s, d: C.ngram_counts(_cleaned(s, d), F.col("t")),
    "ngram_pruned": lambda s, d: C.prune_ngrams(C.ngram_counts(_cleaned(s, d), F.col("t"))),
    "kneser_ney_arpa": lambda s, d: D.arpa_lines(D.kneser_ney(C.prune_ngrams(C.ngram_counts(_cleaned(s, d), F.col("t"), (1, 2)), "0|3"))),
    "arpa_unigrams": lambda s, d: S.arpa_unigrams(D.arpa_lines(D.kneser_ney(C.prune_ngrams(C.ngram_counts(_cleaned(s, d), F.col("t"), (1, 2)), "0|3"))).select(F.lit("lm").alias("file"), (F.col("section") * 10 + F.col("part")).alias("lineno"), "line")),
    "char_vocab": lambda s, d: C.char_vocabulary(spread(read(s, d, "documents").select("text")), F.lower("text")),
    "label_ids": lambda s, d: read(s, d, "benchmark").select("item_id", D.label_ids(T.clean_for_vocabulary(F.col("text"), "en", LETTERS), {c: i + 5 for i, c in enumerate(LETTERS)} | {"|": 4}, 3).alias("ids")).select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids")),
    "punctcap_labels": lambda s, d: C.punctuation_labels(read(s, d, "conversations"), "text", ["conv_id", "turn"]),
    "punctcap_corpus": lambda s, d: C.batch_corpus(C.punctuation_labels(read(s, d, "conversations"), "text", ["conv_id", "turn"]).withColumn("p", F.col("turn") * 1000000 + F.col("pos")), "conv_id", "p", 64),
    "punctcap_batches": lambda s, d: C.batch_words(C.punctuation_labels(read(s, d, "conversations"), "text", ["conv_id", "turn"]).withColumn("p", F.col("turn") * 1000000 + F.col("pos")), "conv_id", "p", 64),
    "tokens_regex": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(T.words_regex(F.col("text")), "|").alias("tokens")),
    "prefix_words": lambda s, d: read(s, d, "benchmark").select("item_id", T.prefix_words(F.col("text"), 3).alias("prefix")),
    "special_characters": lambda s, d: read(s, d, "benchmark").select("item_id", T.drop_listed_characters(F.col("text"), ",?.!-;:").alias("t")),
    "casing_vote": lambda s, d: read(s, d, "conversations").select("conv_id", "turn", T.majority_upper(F.col("role"), F.expr("substring(text, 1 + turn, 3)")).alias("role")),
    "json_field": lambda s, d: read(s, d, "events").select("event_id", S.json_field(F.col("props"), "k").cast("int").alias("k")),
    "path_parts": lambda s, d: read(s, d, "pages").select("page_id", T.stem_of_path(_path()).alias("stem"), T.extension_of_path(_path()).alias("ext"), T.move_path(F.col("url"), "https://", "/mnt/").alias("moved")),
    "topn_per_label": lambda s, d: C.top_n_per_label(read(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5),
    "other_class": lambda s, d: C.other_class(read(s, d, "documents").select("doc_id", "lang"), "lang", ["en", "de"], 10, F.col("doc_id")),
    "train_dev_split": lambda s, d: C.train_dev_split(read(s, d, "documents").select("doc_id"), "doc_id", 100),
    "mixed_corpus": lambda s, d: C.mix_corpora([read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), read(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")], 60, "id"),
    "upsample": lambda s, d: C.upsample(read(s, d, "benchmark"), 3),
    "transcript_join": lambda s, d: read(s, d, "documents").select("doc_id", "lang").join(read(s, d, "labels"), "doc_id"),
    "split_members": lambda s, d: read(s, d, "documents").select("doc_id", "lang").join(read(s, d, "labels"), "doc_id", "left_semi"),
    "unlabelled": lambda s, d: read(s, d, "documents").select("doc_id", "lang").join(read(s, d, "labels"), "doc_id", "left_anti"),
    "cer_by_lang": lambda s, d: A.cer(_cleaned(s, d).select("lang", F.col("t").alias("r"), F.translate("t", "aeiou", "eiou").alias("h")), "r", "h", ["lang"]),
    "wer_by_lang": lambda s, d: A.error_rates(_cleaned(s, d).select("lang", F.col("t").alias("r"), F.regexp_replace("t", " the ", " a ").alias("h")), A.word_edits(F.col("r"), F.col("h")), ["lang"]),
    "sw_align": lambda s, d: read(s, d, "benchmark").select("item_id", A.align_characters(F.col("text"), F.translate(F.expr("substring(text, 11)"), "aeiou", "eiou")).alias("a")).select("item_id", "a.score", A.edit_symbols(F.col("a.pairs")).alias("edits")),
    "aligned_ngrams": lambda s, d: read(s, d, "benchmark").select(A.align_characters(F.col("text"), F.translate("text", "aeiou", "eiou")).alias("a")).select(F.explode(A.aligned_ngrams(F.col("a.pairs"), 3)).alias("g")).groupBy("g.ref", "g.hyp").count(),
    "error_words": lambda s, d: read(s, d, "benchmark").select("item_id", F.explode(A.error_words(F.col("text"), F.translate("text", "aeiou", "eiou"))).alias("w")).select("item_id", "w.ref", "w.hyp"),
    "aligned_lines": lambda s, d: read(s, d, "benchmark").select("item_id", F.posexplode(A.align_lines(F.col("text"), F.translate("text", "aeiou", "eiou"), F.lit(40))).alias("line", "w")).select("item_id", "line", "w.ref", "w.hyp"),
    "matching_blocks": lambda s, d: read(s, d, "benchmark").select("item_id", F.posexplode(A.matching_blocks(F.col("text"), F.expr("substring(text, 21)"))).alias("k", "m")).select("item_id", "k", "m.a", "m.b", "m.size"),
    "accumulate": lambda s, d: G.accumulate_suffixes(_letters(s, d), ["conv_id"], "turn", "ts"),
    "glue_transcripts": lambda s, d: _glued(s, d),
    "overwrite_fold": lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("append"), F.lit(None).cast("string").alias("remove"))).alias("p")).select("conv_id", G.fold_overwrites(F.col("p")).alias("text")),
    "compression_ratio": lambda s, d: read(s, d, "documents").select("doc_id", compression_ratio("text").alias("ratio")).filter("ratio <= 2.0"),
    "sox_commands": lambda s, d: read(s, d, "pages").select("page_id", T.sox_command(F.col("url"), F.lit("out.wav"), F.lit(-3.0), F.lit(100.0), F.lit(7000.0)).alias("cmd")),
    "vocab_except": lambda s, d: C.vocabulary_except(_tokens(s, d, "conversations"), _tokens(s, d, "benchmark"), "token"),
}


def _letters(s, d):
    """Letters of a turn at tenths of a second, turns a second apart, so that they overlap."""
    c = read(s, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split(F.translate("text", " \n", "__"), "")).alias("pos", "letter")).withColumn("ts", F.col("turn") + F.col("pos") * 0.1)


def _path():
    """The url, and a name with up to two dots before an extension, or none."""
    page = F.col("page_id").cast("int")
    return F.concat("url", F.lit("/"), F.repeat(F.lit("v."), page % 3), page.cast("string"), F.when(page % 4 == 0, "").otherwise(F.concat(F.lit(".w"), (page % 7).cast("string"))))


def _tokens(s, d, table):
    return read(s, d, table).select(F.explode(T.simple_tokens(F.lower("text"))).alias("token"))


def _glued(s, d):
    b = read(s, d, "benchmark").select("item_id", F.expr("substring(text, 1, greatest(80, length(text) - 30))").alias("x"), F.expr("substring(text, 31)").alias("y"))
    t = lambda c, first: F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda i: (i + first) * 0.1)
    g = G.glue_suffix(F.struct(F.col("x").alias("letters"), t(F.col("x"), 0).alias("times")), F.struct(F.col("y").alias("letters"), t(F.col("y"), 30).alias("times")))
    return b.filter("length(y) > 0").select("item_id", g.alias("g")).select("item_id", F.col("g.letters").alias("suffix"), F.size("g.times").alias("n"))


ORACLE = {
    "lm_vocab_topk": f"select word, count(*) as n from {WORDS} group by word order by n desc, word limit 50",
    "word_counts": f"select word, count(*) as n from {WORDS} group by word",
    "label_ids": f"select item_id, array_to_string(list_transform(list_filter(string_split(case when {vocabulary_sql('text', 'en')} = '' then '|' else replace({vocabulary_sql('text', 'en')},' ','|') end,''), lambda c: c <> ''), lambda c: case when c = '|' then 4 else instr({quote(LETTERS)}, c) + 4 end),' ') as ids from benchmark",
    "prefix_words": "select item_id, array_to_string(list_slice(f, 1, greatest(2, len(f)-3)),' ') as prefix from (select item_id, list_filter(string_split(text,' '), lambda t: t <> '') as f from benchmark)",
    "special_characters": "select item_id, lower(translate(text, ',?.!-;:', '')) || ' ' as t from benchmark",
    "casing_vote": "select conv_id, turn, case when text is null then lower(role) when x = '' or len(list_filter(string_split(x,''), lambda c: upper(c) = c)) * 2 > length(x) then upper(role) else lower(role) end as role from (select *, substr(text, 1 + turn, 3) as x from conversations)",
    "json_field": "select event_id, cast(json_extract_string(props,'$.k') as integer) as k from events",
    "path_parts": "select page_id, case when len(f) > 1 then array_to_string(f[:-2], '.') else f[1] end as stem, case when len(f) > 1 then f[-1] else '' end as ext, case when starts_with(url,'https://') then '/mnt/' || substr(url,9) else url end as moved from (select *, string_split(repeat('v.', (page_id % 3)::int) || page_id || case when page_id % 4 = 0 then '' else '.w' || (page_id % 7) end, '.') as f from pages)",
    "topn_per_label": "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) rn from documents) where rn <= 5",
    "other_class": "select doc_id, 'other' as lang from documents where lang not in ('en','de') order by doc_id limit 20",
    "train_dev_split": "select doc_id, case when row_number() over (order by doc_id) <= 100 then 'dev' else 'train' end as split from documents",
    "mixed_corpus": "(select doc_id as id, text from documents order by doc_id limit 30) union all (select item_id as id, text from benchmark order by item_id limit 30)",
    "upsample": "select item_id, text, cast(k as integer) as copy from benchmark, generate_series(1,3) g(k)",
    "transcript_join": "select doc_id, lang, quality, toxic from documents join labels using (doc_id)",
    "split_members": "select doc_id, lang from documents where doc_id in (select doc_id from labels)",
    "unlabelled": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "cer_by_lang": f"select lang, sum(levenshtein(r,h)) as errors, sum(length(r)) as ref_chars, sum(levenshtein(r,h))/sum(length(r)) as cer from (select lang, t as r, translate(t,'aeiou','eiou') as h from (select distinct doc_id, lang, t from {CLEANED})) group by lang",
    "sox_commands": "select page_id, 'sox ' || url || ' out.wav gain -3.00 sinc 100-7000' as cmd from pages",
    "vocab_except": "select token from (select distinct unnest(string_split(lower(text), ' ')) as token from conversations) where token <> '' and token not in (select unnest(string_split(lower(text), ' ')) from benchmark where text is not null)",
    "punctcap_labels": f"select conv_id, turn, pos, original, lower(w) as word, (case when substr(original,length(original),1) in (',','.','?') then substr(original,length(original),1) else 'O' end) || (case when regexp_matches(w,'^\\p{{Lu}}') then 'U' else 'O' end) as label from (select conv_id, turn, original, cast(i-1 as integer) as pos, translate(original, {quote(T.ASCII_PUNCTUATION.replace(chr(39), '').replace(chr(92), ''))}, '') as w from (select conv_id, turn, unnest(ws) as original, generate_subscripts(ws,1) as i from (select conv_id, turn, list_filter(regexp_split_to_array(text,'{SQL_SPACES}'), lambda x: x <> '') as ws from conversations))) where w <> ''",
}
for _n in T.cleaner_names():
    QUERIES[f"clean_{_n}"] = lambda s, d, n=_n: spread(read(s, d, "documents").select("doc_id", "text")).select("doc_id", T.cleaner(n)(F.col("text")).alias("text"))
    ORACLE[f"clean_{_n}"] = f"select doc_id, {clean_sql('text', _n)} as text from documents"
_NGRAMS = f"(select n as ngram_order, array_to_string(list_slice(t,i,i+n-1),' ') as gram from (select string_split(t,' ') as t from {CLEANED}), generate_series(1,3) a(n), lateral (select unnest(generate_series(1,len(t)-n+1)) as i))"
ORACLE["ngram_counts"] = f"select cast(ngram_order as integer) as ngram_order, gram, count(*) as n from {_NGRAMS} group by ngram_order, gram"
ORACLE["ngram_pruned"] = f"select * from ({ORACLE['ngram_counts']}) where n > case ngram_order when 1 then 0 when 2 then 8 else 9 end"
ORACLE["accumulate"] = "with l as (select conv_id, turn, i-1 as pos, substr(x,i,1) as letter, turn + (i-1)*0.1::double as ts from (select conv_id, turn, translate(text,' '||chr(10),'__') as x from conversations), lateral (select unnest(generate_series(1, length(x))) as i)), f as (select conv_id, turn, min(ts) as first from l group by all), b as (select conv_id, turn, min(first) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding) as bound from f) select conv_id, string_agg(letter,'' order by turn, ts) as text from l join b using (conv_id, turn) where bound is null or ts < bound group by conv_id"
ORACLE["char_vocab"] = "with c as (select distinct unnest(string_split(lower(text),'')) as c from documents) select case when c = ' ' then '|' else c end as token, row_number() over (order by hex(encode(c))) - 1 as id from c where c <> '' union all select '[UNK]', (select count(*) from c where c <> '') union all select '[PAD]', (select count(*) from c where c <> '') + 1"
ORACLE["punctcap_batches"] = f"select conv_id, (n - 1) // 64 as batch, string_agg(word, ' ' order by n) as text, string_agg(label, ' ' order by n) as labels from (select *, row_number() over (partition by conv_id order by turn, pos) as n from ({ORACLE['punctcap_labels']})) group by 1, 2"
ORACLE["punctcap_corpus"] = f"select (n - 1) // 64 as batch, string_agg(word, ' ' order by n) as text, string_agg(label, ' ' order by n) as labels from (select *, row_number() over (order by conv_id, turn, pos) as n from ({ORACLE['punctcap_labels']})) group by 1"
_WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
ORACLE["tokens_regex"] = f"select item_id, array_to_string(regexp_extract_all(text, '{_WORD}+(?:''{_WORD}+)?|[^\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}\\t-\\r\\x{{85}}\\p{{Z}}]'), '|') as tokens from benchmark"
