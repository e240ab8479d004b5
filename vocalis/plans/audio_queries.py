"""Queries over sample signals: voice segments of pieces, other rates, files that are written and decoded."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vocalis.functions import arrays as R
from vocalis.functions import text as T
from vocalis.operators import perturb as P
from vocalis.operators.alignment import align_characters, padded_lines, whole_distance
from vocalis.operators.decoding import evaluated
from vocalis.operators.training import IGNORED
from vocalis.plans.signal_queries import VOCAB, frames
from vocalis.plans.tables import VECTORS_SQL, read, vectors
from vocalis.sources import audio as A
from vocalis.sources.formats import encode_wav
from vocalis.streaming.voice import voice_batch

#: Samples of a frame and least energy of two frames for the voice query.
FRAME, LEAST = 9, 0.3


def _pieces(s, d):
    """Signals of 20 vectors, in pieces of 7 samples and less, and an end."""
    v = vectors(s, d).select(F.floor(F.col("vec_id") / 20).alias("msg"), (F.col("vec_id") % 20 * 64).alias("at"), "x")
    pieces = v.select("msg", "at", F.posexplode(R.fixed_chunks(F.col("x"), 7)).alias("k", "array")).select("msg", (F.col("at") + F.col("k") * 7).alias("frame_idx"), "array", F.lit(False).alias("end_of_signal"))
    ends = v.groupBy("msg").agg((F.max("at") + 64).alias("frame_idx")).select("msg", "frame_idx", F.array().cast("array<double>").alias("array"), F.lit(True).alias("end_of_signal"))
    return pieces.unionByName(ends).withColumn("message_id", F.col("msg").cast("string"))


def _energy():
    return lambda x: float(np.square(x).sum())


def _resampled(s, d):
    y = A.resampled(F.col("x"), F.lit(2), 3)
    return vectors(s, d).select("vec_id", F.posexplode(y).alias("j", "y")).select("vec_id", "j", (F.round("y", 6) + 0.0).alias("y"))


def _decoded(s, d):
    """Vectors as WAV of 16 bits at 8 Hz, read back from 2 seconds on, 3 seconds of them."""
    files = vectors(s, d).select("vec_id", encode_wav("x", F.lit(8)).alias("content"))
    signal = A.decoded(F.col("content"), F.lit("wav"), F.lit(2.0), F.lit(3.0))
    return files.select("vec_id", signal.alias("s")).select("vec_id", "s.rate", "s.frames", F.posexplode("s.samples").alias("k", "y")).select("vec_id", "rate", "frames", "k", F.round(F.col("y").cast("double") * 32768).cast("long").alias("sample"))


def _perturbed(s, d):
    steps = [(0.5, P.Gain()), (0.5, P.VaryingGain()), (0.5, P.DynamicNoise()), (0.5, P.RandomBand(4.0, 2.0, 10.0)), (0.5, P.Speed())]
    p = P.perturbed(F.col("x"), F.lit(64), F.col("vec_id"), steps, 7)
    return vectors(s, d).select("vec_id", p.alias("p")).select("vec_id", F.size("p.samples").alias("n"), F.array_join("p.applied", ",").alias("applied"), "p.tries", "p.error", F.round(F.aggregate("p.samples", F.lit(0.0), lambda a, v: a + v * v), 4).alias("energy"))


def _voiced(s, d):
    """Two spans in each vector, as a piece of 8 Hz that begins where its place in the message says."""
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.5, 2.0), (3.25, 3.5))))
    cut = R.voice_slices(F.col("x"), (F.col("vec_id") % 20).cast("double") * 8, spans, 8)
    return vectors(s, d).select("vec_id", F.inline(cut)).select("vec_id", "start", "end", F.size("samples").alias("n"), F.get("samples", F.lit(0)).alias("first"))


def _evaluated(s, d):
    """The 20 frames of a message against every second of its best tokens, padded with ignored ids."""
    rows = frames(s, d).groupBy("msg").agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("f")).select("msg", F.transform("f", lambda r: r["x"]).alias("scores"))
    labels = F.transform("scores", lambda x, i: F.when(i % 2 == 0, R.arg_max(x).cast("int")).otherwise(IGNORED))
    e = evaluated(rows.withColumn("labels", labels), "scores", "labels", VOCAB)
    return e.select("msg", "prediction", "reference", whole_distance(F.col("reference"), F.col("prediction")).alias("edits"))


def _commands(s, d):
    f = F.col("file")
    noise = T.sox_noise(f, 0.5, 4000, 100)
    steps = {"pert": T.sox_part(T.sox_varying_gain(f), tempo=0.9, reverb=(30, 50), gain_n=-3.0), "noise": noise, "total": T.sox_sum([noise, T.sox_part(f, pitch=-20)], F.lit("out.wav"), f), "phone": T.sox_transcode(f, F.lit("out.wav"), F.when(F.col("page_id") % 2 == 0, "g711").otherwise((F.col("page_id") % 10).cast("string")))}
    return read(s, d, "pages").withColumn("file", F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit(".wav"))).select("page_id", *(c.alias(k) for k, c in steps.items()))


QUERIES = {
    "voice_slices": _voiced,
    "ctc_evaluated": _evaluated,
    "sox_chains": _commands,
    "padded_lines": lambda s, d: read(s, d, "benchmark").select("item_id", align_characters(F.col("text"), F.translate("text", "aeiou", "eiou")).alias("a")).select("item_id", padded_lines(F.col("a.pairs")).alias("p")).select("item_id", "p.*"),
    "voice_stream": lambda s, d: voice_batch(_pieces(s, d), _energy, FRAME, 2, LEAST),
    "resample_signals": _resampled,
    "decode_parts": _decoded,
    "perturb_signals": _perturbed,
}

_CUT = A.ROLLOFF
_HALF = math.ceil(A.CROSSINGS / _CUT)
_T = f"({_CUT}::double * (j*2/3.0::double - k))"
_SYMBOLS = "[" + ",".join("'" + (" " if v == "|" else v.replace("'", "''")) + "'" for v in VOCAB) + "]"
_VARY = "'sox -T <(sox -m <(sox ' || f || ' -p synth whitenoise lowpass 1 gain -n -6) <(sox ' || f || ' -p gain -90 dcshift 0.5) -p) <(sox ' || f || ' -p ) -p'"
_NOISE = "'sox ' || f || ' -p synth whitenoise lowpass 0.5 synth whitenoise amod gain -n -4 sinc 100-4000'"
ORACLE = {
    "voice_slices": f"select vec_id, (vec_id % 20)*8.0::double + a as start, (vec_id % 20)*8.0::double + b as \"end\", cast(n as integer) as n, x[i] as first from {VECTORS_SQL}, (values (0.5::double, 2.0::double, 12, 5), (3.25::double, 3.5::double, 2, 27)) c(a, b, n, i)",
    "ctc_evaluated": f"""with f as (select vec_id // 20 as msg, vec_id % 20 as frame, list_position(embedding, list_max(embedding)) - 1 as id from embeddings),
 r as (select *, lag(id) over (partition by msg order by frame) as b, row_number() over (partition by msg order by frame) - 1 as i from f),
 t as (select msg, trim(coalesce(string_agg(({_SYMBOLS})[id+1], '' order by frame) filter (where id <> 0 and (b is null or b <> id)), ''), ' ') as prediction, trim(coalesce(string_agg(({_SYMBOLS})[id+1], '' order by frame) filter (where id <> 0 and i % 2 = 0), ''), ' ') as reference from r group by msg)
 select *, cast(levenshtein(reference, prediction) as integer) as edits from t""",
    "sox_chains": f"select page_id, 'sox <(' || {_VARY} || ') -p tempo 0.9 reverb 30 50 gain -n -3.0' as pert, {_NOISE} as noise, 'sox -m <(' || {_NOISE} || ') <(sox ' || f || ' -p pitch -20) -b 16 out.wav trim 0 $(soxi -D ' || f || ')' as total, case when page_id % 2 = 0 then 'sox ' || f || ' -V0  -r 8000 -c 1 -e a-law out.wav' when page_id % 10 < 8 then 'sox ' || f || ' -V0 -C ' || page_id % 10 || ' -t amr-nb - | sox -t amr-nb - -V0 -b 16 -r 16000 out.wav' end as phone from (select page_id, 'a' || page_id || '.wav' as f from pages)",
    "voice_stream": f"""with recursive s as (select vec_id // 20 as msg, (vec_id % 20)*64 + i - 1 as p, x[i] as v from {VECTORS_SQL}, lateral (select unnest(generate_series(1, len(x))) as i)),
 f as (select msg, p // {FRAME} as k, sum(v*v) as e, count(*) as n from s group by all),
 g as (select msg, k, n, e + coalesce(lag(e) over (partition by msg order by k), 0) >= {LEAST} as voiced, max(k) over (partition by msg) as last from f),
 r as (select distinct msg, -1::bigint as k, 2::bigint as l, -1::bigint as b, 0::bigint as kept, null::bigint as "start", null::bigint as "end" from g
  union all select g.msg, g.k, case when voiced then 2 else l - 1 end,
   case when voiced or l > 0 then case when b < 0 then g.k*{FRAME} else b end else -1 end,
   case when voiced or l > 0 then kept else {FRAME} end,
   case when not voiced and l <= 0 and b >= 0 then b - kept end,
   case when not voiced and l <= 0 and b >= 0 then (g.k - 1)*{FRAME} end
  from r join g on g.msg = r.msg and g.k = r.k + 1),
 found as (select msg, "start", "end" from r where "end" is not null
  union all select g.msg, b - kept, g.k*{FRAME} + n from r join g on g.msg = r.msg and g.k = r.k and g.k = last where b >= 0)
 select msg::varchar as message_id, row_number() over (partition by msg order by "end") - 1 as segment, "start", "end", true as final from found""",
    "resample_signals": f"""with w as (select j, k, case when abs({_T}) >= {A.CROSSINGS} then 0 else case when {_T} = 0 then 1 else sin(pi()*{_T})/(pi()*{_T}) end * cos(pi()*{_T}/{2 * A.CROSSINGS})**2 end as h
  from generate_series(0, 95) a(j), lateral (select unnest(generate_series(j*2//3 - {_HALF}, j*2//3 + {_HALF})) as k)),
 n as (select *, h / sum(h) over (partition by j) as u from w)
 select vec_id, cast(j as integer) as j, round(sum(x[k+1] * u), 6) + 0.0 as y from {VECTORS_SQL}, n where k between 0 and 63 group by vec_id, j""",
    "decode_parts": f"select vec_id, 8::integer as rate, 64::bigint as frames, cast(i as integer) as k, cast(trunc(x[i+17] * 32767) as bigint) as sample from {VECTORS_SQL}, generate_series(0, 23) g(i)",
}
