"""From frame scores to text: greedy and beam CTC decoding, n-gram language models."""

from __future__ import annotations

import math

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from vocalis.functions.udf import arrow_function

from vocalis.functions.arrays import arg_max


def ctc_greedy(frames: DataFrame, keys: list[str], frame: str, logits: str, vocab: list[str], blank: int = 0, delimiter: str = "|") -> DataFrame:
    """Best symbol of each frame, repeats collapsed, blanks dropped; with the frame where each symbol begins."""
    w = Window.partitionBy(*keys).orderBy(frame)
    best = frames.select(*keys, F.col(frame).alias("frame"), arg_max(F.col(logits)).alias("id"))
    runs = best.withColumn("before", F.lag("id").over(w.orderBy("frame"))).filter((F.col("id") != blank) & (F.col("before").isNull() | (F.col("before") != F.col("id"))))
    symbols = F.array(*[F.lit(" " if v == delimiter else v) for v in vocab])
    kept = runs.select(*keys, "frame", F.get(symbols, F.col("id").cast("int")).alias("c")).filter(F.length("c") == 1)
    text = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "c"))).alias("o"))
    every = frames.select(*keys).distinct()
    out = every.join(text, keys, "left")
    return out.select(*keys, F.coalesce(F.array_join(F.transform("o", lambda x: x["c"]), ""), F.lit(" ")).alias("text"), F.coalesce(F.transform("o", lambda x: x["frame"].cast("long")), F.array(F.lit(0).cast("long"))).alias("frames"))


def decode_ids(ids: Column, vocab: list[str], pad: int = 0, grouped: bool = True, delimiter: str = "|") -> Column:
    """Token ids to a text: repeats count once if ``grouped``; padding, unknown and ignored (negative) ids go, delimiters are spaces at which ends are trimmed."""
    first = lambda x, i: x != F.coalesce(F.get(ids, i - 1), F.lit(-1))
    kept = F.filter(ids, lambda x, i: first(x, i) & (x != pad)) if grouped else F.filter(ids, lambda x: x != pad)
    symbols = F.array(*[F.lit(" " if v == delimiter else v) for v in vocab])
    return F.trim(F.array_join(F.transform(kept, lambda x: F.get(symbols, F.when(x >= 0, x).cast("int"))), ""))


def evaluated(df: DataFrame, scores: str, labels: str, vocab: list[str], pad: int = 0, delimiter: str = "|") -> DataFrame:
    """``prediction`` and ``reference`` of a batch: the best token of each row of ``scores``, repeats collapsed, against label ids, repeats kept."""
    best = F.transform(scores, lambda x: arg_max(x).cast("int"))
    return df.withColumns({"prediction": decode_ids(best, vocab, pad, True, delimiter), "reference": decode_ids(F.col(labels), vocab, pad, False, delimiter)})


def beam_search(logp: list[list[float]], vocab: list[str], blank: int, width: int, lm: dict[tuple[str, ...], tuple[float, float]] | None, alpha: float, beta: float, unknown: float = -10.0) -> list[tuple[str, float]]:
    """Prefix beam search; at each word's end the language model's log10 probability and a word bonus are added."""

    def word_score(words: tuple[str, ...]) -> float:
        if lm is None or not words:
            return 0.0
        back, context = 0.0, words[-3:]
        while context:
            if context in lm:
                return alpha * math.log(10) * (back + lm[context][0]) + beta
            back += lm.get(context[:-1], (0.0, 0.0))[1] if len(context) > 1 else 0.0
            context = context[1:]
        return alpha * math.log(10) * (back + unknown) + beta

    def add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        m = max(a, b)
        return m + math.log(math.exp(a - m) + math.exp(b - m)) if b != -math.inf else a

    beams: dict[str, tuple[float, float, float]] = {"": (0.0, -math.inf, 0.0)}
    for row in logp:
        new: dict[str, list[float]] = {}
        for text, (pb, pn, extra) in beams.items():
            for i, p in enumerate(row):
                total = add(pb, pn)
                if i == blank:
                    e = new.setdefault(text, [-math.inf, -math.inf, extra])
                    e[0] = add(e[0], total + p)
                    continue
                c = vocab[i]
                if text and text[-1] == c:
                    e = new.setdefault(text, [-math.inf, -math.inf, extra])
                    e[1] = add(e[1], pn + p)
                    total = pb
                if total == -math.inf:
                    continue
                more = extra + (word_score(tuple(text.split())) if c == " " and text and text[-1] != " " else 0.0)
                e = new.setdefault(text + c, [-math.inf, -math.inf, more])
                e[1] = add(e[1], total + p)
        beams = dict(sorted(((t, (a, b, x)) for t, (a, b, x) in new.items()), key=lambda kv: (-(add(kv[1][0], kv[1][1]) + kv[1][2]), kv[0]))[:width])
    done = [(t, add(a, b) + x + (word_score(tuple(t.split())) if t and t[-1] != " " else 0.0)) for t, (a, b, x) in beams.items()]
    return sorted(done, key=lambda d: (-d[1], d[0]))


def ctc_beams(vocab: list[str], blank: int = 0, width: int = 16, n_best: int = 3, lm: dict | None = None, alpha: float = 1.0, beta: float = 0.5, delimiter: str = "|"):
    """A function of a column of frames (array of arrays of logits) that gives the best beams; ``lm`` is a table of bounded size."""
    letters = [" " if v == delimiter else v for v in vocab]

    @arrow_function("array<struct<text:string,score:double>>")
    def decode(frames: pd.Series) -> pd.Series:
        out = []
        for rows in frames:
            logp = []
            for r in rows:
                m = max(r)
                z = m + math.log(sum(math.exp(x - m) for x in r))
                logp.append([float(x - z) for x in r])
            out.append([{"text": t, "score": s} for t, s in beam_search(logp, letters, blank, width, lm, alpha, beta)[:n_best]])
        return pd.Series(out)

    return decode


def kneser_ney(counts: DataFrame, discount: float = 0.75) -> DataFrame:
    """Bigram and unigram log10 probabilities with interpolated Kneser-Ney and one discount.

    ``counts`` has ``ngram_order, gram, n`` of orders 1 and 2. Returns ``ngram_order, gram, log10p, backoff``.
    The bigrams are counted once, at once, and lie on the executors' disks as long as the model is in use.
    """
    two = counts.filter("ngram_order = 2").select("gram", "n").localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    two = two.select("gram", "n", F.substring_index("gram", " ", 1).alias("w1"), F.substring_index("gram", " ", -1).alias("w2"))
    kinds = two.agg(F.count(F.lit(1)).cast("double").alias("kinds"))
    # one row, a count
    ends = two.groupBy("w2").agg(F.count(F.lit(1)).alias("left_kinds")).join(F.broadcast(kinds)).select(F.col("w2").alias("word"), (F.col("left_kinds") / F.col("kinds")).alias("p"))
    starts = two.groupBy("w1").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("right_kinds"))
    back = starts.select(F.col("w1").alias("word"), (discount * F.col("right_kinds") / F.col("total")).alias("gamma"))
    uni = ends.join(back, "word", "left").select(F.lit(1).alias("ngram_order"), F.col("word").alias("gram"), F.log10("p").alias("log10p"), F.log10("gamma").alias("backoff"))
    bi = two.join(starts, "w1").join(ends.withColumnRenamed("word", "w2"), "w2")
    p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("right_kinds") / F.col("total") * F.col("p")
    return uni.unionByName(bi.select(F.lit(2).alias("ngram_order"), "gram", F.log10(p).alias("log10p"), F.lit(None).cast("double").alias("backoff")))


def arpa_lines(model: DataFrame) -> DataFrame:
    """Lines of an ARPA file with the place of each: header, sections, end."""
    line = F.concat_ws("\t", F.format_string("%.6f", F.col("log10p")), "gram", F.when(F.col("backoff").isNotNull(), F.format_string("%.6f", F.col("backoff"))))
    body = model.select(F.col("ngram_order").alias("section"), F.lit(1).alias("part"), F.col("gram").alias("key"), line.alias("line"))
    sizes = model.groupBy("ngram_order").agg(F.count(F.lit(1)).alias("n"))
    count = F.struct(F.lit(0).alias("section"), F.lit(1).alias("part"), F.col("ngram_order").cast("string").alias("key"), F.format_string("ngram %d=%d", "ngram_order", "n").alias("line"))
    head = F.struct(F.col("ngram_order").alias("section"), F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("\\%d-grams:", "ngram_order").alias("line"))
    ends = model.sparkSession.range(1).selectExpr(r"inline(array(named_struct('section', 0, 'part', 0, 'key', '', 'line', r'\data\'), named_struct('section', 99, 'part', 0, 'key', '', 'line', r'\end\')))")
    return body.unionByName(sizes.select(F.inline(F.array(count, head)))).unionByName(ends)


def label_ids(text: Column, ids: dict[str, int], unknown: int, delimiter: str = "|") -> Column:
    """Ids of a text's characters; an empty text is one delimiter."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    t = F.when(F.length(text) == 0, F.lit(delimiter)).otherwise(F.translate(text, " ", delimiter))
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)))
