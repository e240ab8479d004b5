"""Queries over timed tokens, subtitle blocks and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalis.functions import arrays as R
from vocalis.functions.text import drop_newlines
from vocalis.operators import subtitles as B
from vocalis.operators import training as P
from vocalis.plans.tables import VECTORS_SQL, read, segments, segments_sql, vectors
from vocalis.streaming.transcriber import ctc_model, transcribe_batch


def _timed(s, d, text):
    t = B.timed_tokens(text, F.col("turn").cast("double"), (F.col("turn") + 1).cast("double"))
    return read(s, d, "conversations").select("conv_id", "turn", F.posexplode(t).alias("k", "x")).select("conv_id", "turn", "k", "x.token", "x.ts")


def _placed(s, d, text):
    return _timed(s, d, text).select("conv_id", (F.col("turn") * 1000000 + F.col("k")).alias("pos"), "token", "ts")


def _examples(s, d):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return read(s, d, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.length(w).cast("double")).alias("x"), F.transform(F.slice(words, 1, F.col("turn") + 1), lambda w: F.length(w)).alias("y"))


def _languages(s, d):
    langs = read(s, d, "documents").filter("lang is not null").select(F.col("lang").alias("token")).distinct()
    return langs.agg(F.array_sort(F.collect_set("token")).alias("t")).select(F.posexplode("t").alias("id", "token"))


def _messages(s, d):
    """Signals of 64 samples in pieces of 7, and an end."""
    v = vectors(s, d).select(F.col("vec_id").cast("string").alias("message_id"), "x")
    pieces = v.select("message_id", F.posexplode(R.fixed_chunks(F.col("x"), 7)).alias("k", "array"))
    last = v.select("message_id", F.size("x").cast("long").alias("frame_idx"), F.array().cast("array<double>").alias("array"), F.lit(True).alias("end_of_signal"))
    return pieces.select("message_id", (F.col("k") * 7).cast("long").alias("frame_idx"), "array", F.lit(False).alias("end_of_signal")).unionByName(last)


def _letters_of():
    """A toy model: a frame is four samples and the largest one's place its token."""
    return ctc_model(lambda x: x[: len(x) // 4 * 4].reshape(-1, 4), ["<pad>", "a", "b", "c"], 8)


QUERIES = {
    "transcribe_messages": lambda s, d: transcribe_batch(_messages(s, d), _letters_of, 8, 20, 8).select("message_id", "frame_idx", "letters", F.size("times").alias("n"), "end_of_message"),
    "timed_tokens": lambda s, d: _timed(s, d, F.col("text")),
    "subtitle_blocks": lambda s, d: B.subtitle_blocks(_placed(s, d, F.col("text")), _placed(s, d, F.reverse("text")), "conv_id"),
    "length_filter": lambda s, d: _examples(s, d).filter(P.length_between(F.col("x"), 20, 60)).select("conv_id", "turn"),
    "partial_chunks": lambda s, d: vectors(s, d).select("vec_id", F.posexplode(R.fixed_chunks(F.col("x"), 15)).alias("k", "c")).filter(P.more_than_half(F.col("c"), 0.9375, 16)).select("vec_id", "k", F.size("c").alias("n")),
    "calibration_filter": lambda s, d: P.within_audio(segments(s, d), F.lit(1704196800.0)).select("event_id"),
    "capital_filter": lambda s, d: read(s, d, "conversations").filter(P.speech_like(F.col("text"), F.col("turn"))).select("conv_id", "turn"),
    "whole_segments": lambda s, d: P.whole_segments(read(s, d, "documents"), "doc_id"),
    "segment_totals": lambda s, d: P.segment_totals(segments(s, d), ["label"]).select("label", F.round("seconds", 3).alias("seconds"), "n"),
    "zip_positions": lambda s, d: P.zip_by_position(vectors(s, d).select("vec_id", "x", F.transform("x", lambda e: e * 2).alias("y")), "x", "y"),
    "training_vocab": lambda s, d: P.training_vocabulary(_languages(s, d), "|", "[UNK]", "[PAD]"),
    "vocab_json": lambda s, d: P.vocabulary_json(P.training_vocabulary(_languages(s, d), "|", "[UNK]", "[PAD]")),
    "padded_batches": lambda s, d: P.padded_batches(_examples(s, d), "conv_id", "x", "y", 8).select("conv_id", "turn", F.size("x").alias("width"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("real"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("y").alias("labels"), F.size(F.filter("y", lambda v: v == P.IGNORED)).alias("ignored")),
    "shuffled": lambda s, d: P.shuffled(read(s, d, "labels"), 7),
    "sized_chunks": lambda s, d: vectors(s, d).select("vec_id", F.posexplode(R.sized_chunks(F.col("x"), F.array(*(F.lit(n) for n in (10, 30, 40, 5))))).alias("k", "c")).select("vec_id", "k", F.when(F.col("c").isNotNull(), F.size("c")).alias("n"), F.get("c", F.lit(0)).alias("first")),
    "elements_at": lambda s, d: vectors(s, d).select("vec_id", F.posexplode(R.elements_at(F.col("x"), F.array(F.lit(0), F.lit(5), F.lit(63)))).alias("k", "v")),
    "drop_newlines": lambda s, d: read(s, d, "documents").select("doc_id", drop_newlines(F.col("text"), " ").alias("text")),
}
_WORDS = "(select conv_id, turn, string_split(text,' ') as w, len(string_split(text,' ')) as m from conversations where text is not null)"
_EXAMPLES = "(select conv_id, turn, string_split(coalesce(text,''),' ') as w from conversations)"
_VOCAB = "(select lang as token, row_number() over (order by encode(lang)) - 1 as id from (select distinct lang from documents where lang is not null))"
_FULL = f"(select case when token = ' ' then '|' else token end as token, id from {_VOCAB} union all select '[UNK]', (select count(*) from {_VOCAB}) union all select '[PAD]', (select count(*) + 1 from {_VOCAB}))"
ORACLE = {
    "timed_tokens": f"select conv_id, turn, cast(i-1 as integer) as k, w[i] as token, case when m = 1 then turn::double else (turn*1000 + q + case when 2*r > m-1 or (2*r = m-1 and (turn*1000 + q) % 2 = 1) then 1 else 0 end) / 1000.0::double end as ts from (select *, case when m > 1 then (i-1)*1000 // (m-1) end as q, case when m > 1 then (i-1)*1000 % (m-1) end as r from {_WORDS}, lateral (select unnest(generate_series(1, m)) as i)) union all select conv_id, turn, cast(m as integer), ' ', turn + 1 from {_WORDS}",
    "length_filter": f"select conv_id, turn from {_EXAMPLES} where len(w) > 20 and len(w) < 60",
    "partial_chunks": f"select vec_id, cast(k as integer) as k, cast(least(15, len(x)-k*15) as integer) as n from {VECTORS_SQL}, generate_series(0,4) g(k) where least(15, len(x)-k*15) > 7.5",
    "calibration_filter": f"select event_id from {segments_sql()} where start <= 1704196800.0",
    "capital_filter": "select conv_id, turn from conversations where turn = 0 or regexp_matches(text, '[A-Z]')",
    "whole_segments": "select doc_id as id, doc_id as audio_id, 0.0::double as start, null::double as \"end\" from documents",
    "segment_totals": f"select label, round(sum(\"end\" - start), 3) as seconds, count(*) as n from {segments_sql()} group by label",
    "zip_positions": f"select vec_id, cast(i-1 as integer) as pos, x[i] as x, x[i]*2 as y from {VECTORS_SQL}, lateral (select unnest(generate_series(1, len(x))) as i)",
    "training_vocab": f"select token, id from {_FULL}",
    "vocab_json": f"select '{{' || string_agg('\"' || token || '\":' || id, ',' order by id) || '}}' as line from {_FULL}",
    "padded_batches": f"select conv_id, turn, cast(ceil(max(len(w)) over p / 8.0) * 8 as integer) as width, cast(len(w) as integer) as real, list_sum(list_transform(w, lambda e: length(e)))::double as total, cast(max(least(turn + 1, len(w))) over p as integer) as labels, cast(max(least(turn + 1, len(w))) over p - least(turn + 1, len(w)) as integer) as ignored from {_EXAMPLES} window p as (partition by conv_id)",
    "shuffled": "select * from labels",
    "sized_chunks": f"select vec_id, cast(k as integer) as k, case when k < 3 then cast(least(n, len(x)-b) as integer) end as n, case when k < 3 then x[b+1] end as first from {VECTORS_SQL}, (values (0,10,0),(1,30,10),(2,40,40),(3,5,80)) c(k,n,b)",
    "elements_at": f"select vec_id, cast(k as integer) as k, x[i] as v from {VECTORS_SQL}, (values (0,1),(1,6),(2,64)) c(k,i)",
    "drop_newlines": "select doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') as text from documents",
}
