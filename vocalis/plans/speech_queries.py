"""Queries over speech streams, language models and their decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalis.functions import arrays as R
from vocalis.operators import diarization as E
from vocalis.operators import langmodel as L
from vocalis.operators import voice as V
from vocalis.operators.decoding import ctc_greedy
from vocalis.plans.signal_queries import VOCAB, frames
from vocalis.plans.tables import read, segments, segments_sql, spread
from vocalis.streaming.overwriter import WORD_START, fold_responses, overwrite_batch, response_text, spelled_model

HOP = 12


def _spoken(s, d):
    """A customer's order numbers as words, a word for each order, spelled in samples, in pieces of 50."""
    o = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("message_id"), "o_orderkey")
    codes = F.transform(F.split(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), ""), lambda c: F.ascii(c).cast("double"))
    word = F.transform(F.sequence(F.lit(0), F.lit(HOP - 1)), lambda i: F.when(i == 0, F.get(codes, i) + WORD_START).otherwise(F.coalesce(F.get(codes, i), F.lit(0.0))))
    spoken = o.withColumn("w", word).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "w"))).alias("w"))
    samples = spoken.select("message_id", F.flatten(F.transform("w", lambda x: x["w"])).alias("x"))
    pieces = samples.select("message_id", F.posexplode(R.fixed_chunks(F.col("x"), 50)).alias("k", "array"))
    end = samples.select("message_id", F.size("x").cast("long").alias("frame_idx"), F.array().cast("array<double>").alias("array"), F.lit(True).alias("end_of_signal"))
    return pieces.select("message_id", (F.col("k") * 50).cast("long").alias("frame_idx"), "array", F.lit(False).alias("end_of_signal")).unionByName(end)


def _overwrites(s, d):
    """Windows of eight words, three words apart; the words of a window but the last three are the next one's prefix."""
    said = overwrite_batch(_spoken(s, d), lambda: spelled_model(HOP, HOP), HOP, 8 * HOP, 3 * HOP)
    return fold_responses(said.withColumn("more", response_text()), ["message_id"], ["response"], append="more")


def _sentences(s, d):
    return spread(read(s, d, "conversations").select("text")).select(F.split("text", " ").alias("t"))


def _model(s, d):
    return L.modified_kneser_ney(L.sentence_grams(_sentences(s, d), F.col("t"), 3), 3, "0|1|1")


def _rounded(model):
    return model.select("ngram_order", "gram", F.round("log10p", 5).alias("log10p"), F.round("backoff", 5).alias("backoff"))


def _decoded(s, d):
    """All signals, decoded with a model of what greedy decoding hears in them."""
    x = frames(s, d)
    heard = ctc_greedy(x, ["msg"], "frame", "x", VOCAB).select(F.split("text", " ").alias("t"))
    model = L.hashed_model(L.modified_kneser_ney(L.sentence_grams(heard, F.col("t"), 3), 3))
    return L.decode_beams(x, ["msg"], "frame", "x", VOCAB, model, width=20).select("msg", "rank", "text", F.round("score", 6).alias("score"))


SCALE, SHIFT, COLLAR = 3000.0, 900.0, 120.0


def _speakers(s, d):
    """Event types as speakers, users as files; the reference begins a quarter of an hour later."""
    x = segments(s, d, SCALE).select(F.col("user_id").alias("file"), "start", "end", F.col("label").alias("speaker"))
    return x.withColumn("start", F.col("start") + SHIFT), x


def _times(s, d):
    ref, sys = _speakers(s, d)
    r, y = F.size("ref"), F.size("sys")
    sums = {"scored": r, "missed": F.greatest(r - y, F.lit(0)), "false": F.greatest(y - r, F.lit(0)), "both": F.least(r, y)}
    return E.elementary_intervals(ref, sys, collar=COLLAR).groupBy("file").agg(*(F.round(F.sum(F.col("seconds") * n), 2).alias(c) for c, n in sums.items()))


def _report(s, d):
    ref, sys = _speakers(s, d)
    return E.diarization_report(ref, sys, collar=COLLAR, ignore_overlap=True).select("file", *(F.round(c, 4).alias(c) for c in ("scored", "miss", "false_alarm", "confusion", "der")))


def _voice(how):
    def query(s, d):
        frame = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
        x = read(s, d, "events").select("user_id", frame.alias("i"), (F.col("value") / 50).alias("p"))
        smooth = V.smoothed_scores(x, ["user_id"], "i", "p", 4, how)
        found = V.offline_voice_segments(smooth, ["user_id"], "i", "smooth", 0.25, 0.6, 0.4, 0.125, 0.25, 0.75, 0.5)
        return found.select("user_id", "start", "end")

    return query


QUERIES = {
    "diarization_times": _times,
    "diarization_report": _report,
    "ami": lambda s, d: E.adjusted_mutual_information(read(s, d, "documents"), "lang", "source").select(F.round("ami", 9).alias("ami")),
    "voice_mean": _voice("mean"),
    "voice_median": _voice("median"),
    "overwrites": _overwrites,
    "modified_kneser_ney": lambda s, d: _rounded(_model(s, d)),
    "lm_decode": _decoded,
}

_GRAMS = """
s as (select ['<s>'] || list_filter(string_split(text, ' '), lambda w: w <> '') || ['</s>'] as t from conversations where text is not null union all select ['<s>', '</s>'] from conversations where text is null),
g as (select o, array_to_string(t[i:i + o - 1], ' ') as gram, array_to_string(t[i:i + o - 2], ' ') as context, array_to_string(t[i + 1:i + o - 1], ' ') as suffix, t[i] = '<s>' as framed
  from s, (values (1), (2), (3)) orders(o), lateral (select unnest(generate_series(1, len(t) - o + 1)) as i)),
raw as (select o, gram, any_value(context) as context, any_value(suffix) as suffix, any_value(framed) as framed, count(*) as n from g group by o, gram),
kinds as (select o - 1 as o, suffix as gram, count(*) as k from raw where o > 1 group by 1, 2),
a as (select raw.*, case when raw.o = 3 or framed then n else coalesce(k, 0) end as a, o > 1 and n <= 1 as gone from raw left join kinds using (o, gram) where gram <> '<s>'),
t as (select o, count(*) filter (where a = 1)::double as t1, count(*) filter (where a = 2)::double as t2, count(*) filter (where a = 3)::double as t3, count(*) filter (where a = 4)::double as t4 from a group by o),
y as (select *, t1 / (t1 + 2 * t2) as y from t),
f as (select o, 1 - 2 * y * t2 / t1 as d1, 2 - 3 * y * t3 / t2 as d2, 3 - 4 * y * t4 / t3 as d3, t1 > 0 and t2 > 0 and t3 > 0 as enough from y),
c as (select o, enough and d1 between 0 and 1 and d2 between 0 and 2 and d3 between 0 and 3 as ok, d1, d2, d3 from f),
d as (select a.*, case least(a, 3) when 0 then 0 when 1 then case when ok then d1 else 0.5 end when 2 then case when ok then d2 else 1.0 end else case when ok then d3 else 1.5 end end as d from a join c using (o)),
w as (select o, context, sum(a)::double as total, sum(case when gone then a else d end) as taken from d group by o, context),
q as (select o, context, case when total > 0 then taken / total else 1 end as gamma, total from w),
u as (select d.o, gram, suffix, gamma, case when total > 0 then (a - d) / total else 0 end as u from d join q using (o, context) where not gone),
e as (select gamma / (select count(*) + 1 from u where o = 1) as even from q where o = 1),
p1 as (select gram, u + even as p from u, e where o = 1 union all select '<unk>', even from e),
p2 as (select u.gram, u.u + gamma * p1.p as p from u join p1 on u.suffix = p1.gram where o = 2),
p3 as (select u.gram, u.u + gamma * p2.p as p from u join p2 on u.suffix = p2.gram where o = 3),
p as (select 1 as o, gram, p from p1 union all select 1, '<s>', 1.0 union all select 2, gram, p from p2 union all select 3, gram, p from p3)"""
_SPEAKERS = f"r as (select user_id as file, start + {SHIFT} as s, \"end\" as e, label as w from {segments_sql(SCALE)} where start + {SHIFT} < \"end\"), span as (select file, min(s) as lo, max(e) as hi from r group by file), y as (select * from (select user_id as file, greatest(start, lo) as s, least(\"end\", hi) as e, label as w from {segments_sql(SCALE)} join span on span.file = user_id) where s < e)"


def _voice_sql(smooth):
    state = "case when p > 0.6 then 1 when p < 0.4 then 0 end"
    order = "partition by user_id order by i"
    return f"""
with x as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, value / 50 as q from events),
m as (select user_id, i, {smooth} as p from x window w as ({order} rows between 3 preceding and current row)),
o as (select *, coalesce(last_value({state} ignore nulls) over ({order} rows between unbounded preceding and current row), 0) as on_ from m),
e as (select *, coalesce(lag(on_) over ({order}), 0) as was, lead(on_) over ({order}) as next from o),
n as (select *, sum((on_ > was)::int) over ({order} rows between unbounded preceding and current row) as run from e),
g as (select user_id, run, greatest(min(i) * 0.25::double - 0.125, 0) as s, max(case when next is null then i when next = 0 then i + 1 end) * 0.25::double + 0.25 as e from n where on_ = 1 group by user_id, run),
c as (select user_id, s, e, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from g where e > s),
d as (select *, sum((reach is null or s > reach)::int) over (partition by user_id order by s, e rows between unbounded preceding and current row) as k from c),
t as (select user_id, min(s) as s, max(e) as e from d group by user_id, k having max(e) - min(s) >= 0.75),
u as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from t),
v as (select *, sum((reach is null or (s > reach and s - reach >= 0.5))::int) over (partition by user_id order by s, e rows between unbounded preceding and current row) as k from u)
select user_id, min(s) as start, max(e) as "end" from v group by user_id, k"""


ORACLE = {
    "diarization_times": f"""
with {_SPEAKERS},
z as (select file, t - {COLLAR} as s, t + {COLLAR} as e from (select file, s as t from r union all select file, e from r)),
t as (select file, s as t from r union select file, e from r union select file, s from y union select file, e from y union select file, s from z union select file, e from z),
i as (select file, t as a, lead(t) over (partition by file order by t) as b from t),
n as (select file, b - a as d, (select count(distinct w) from r where r.file = i.file and s <= a and e >= b) as nr, (select count(distinct w) from y where y.file = i.file and s <= a and e >= b) as ny from i
  where b is not null and not exists (select 1 from z where z.file = i.file and s <= a and e >= b))
select file, round(sum(d * nr), 2) as scored, round(sum(d * greatest(nr - ny, 0)), 2) as missed, round(sum(d * greatest(ny - nr, 0)), 2) as false, round(sum(d * least(nr, ny)), 2) as both from n where nr + ny > 0 group by file""",
    "ami": """
with c as (select lang as a, source as b, count(*)::double as n from documents group by 1, 2), r as (select a, sum(n) as n from c group by a), s as (select b, sum(n) as n from c group by b),
t as (select sum(n) as n, sum(n * ln(n)) as l from c), u as (select sum(n * ln(n)) as l, count(*) as k from r), v as (select sum(n * ln(n)) as l, count(*) as k from s),
e as (select sum(k / t.n * ln(t.n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t.n - x + 1) + lgamma(t.n - y + 1) - lgamma(t.n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t.n - x - y + k + 1))) as e
  from t, (select r.n as x, s.n as y, unnest(generate_series(greatest(1, r.n + s.n - (select n from t))::bigint, least(r.n, s.n)::bigint)) as k from r, s))
select round(((t.l - u.l - v.l) / t.n + ln(t.n) - e) / (ln(t.n) - (u.l + v.l) / t.n / 2 - e), 9) as ami from t, u, v, e""",
    "voice_mean": _voice_sql("avg(q) over w"),
    "voice_median": _voice_sql("median(q) over w"),
    "overwrites": "select o_custkey::varchar as message_id, string_agg(' O' || o_orderkey, '' order by o_orderkey) as text from orders group by 1",
    "modified_kneser_ney": f"with {_GRAMS} select p.o as ngram_order, gram, round(log10(p), 5) as log10p, case when p.o < 3 then round(coalesce(log10(gamma), 0), 5) end as backoff from p left join q on q.o = p.o + 1 and q.context = p.gram",
}
