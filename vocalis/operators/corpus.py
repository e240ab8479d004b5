"""Corpora as tables: counts, vocabularies, mixing, splitting, batching, training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.functions.text import drop_punctuation
from vocalis.operators.ordinals import number_rows


def token_counts(df: DataFrame, text: Column) -> DataFrame:
    """Tokens between single spaces, empty ones included."""
    return df.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(k)


def ngram_counts(df: DataFrame, text: Column, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Counts of runs of tokens, of each order."""
    t = df.select(F.split(text, " ").alias("t"))
    words = [f"w{k}" for k in range(max(orders))]
    # a row for each place with the words from there on, null behind the end; texts of built-in expressions, since functions of elements are not compiled
    places = t.select(F.inline(F.arrays_zip(*(F.slice("t", k + 1, F.size("t")).alias(w) for k, w in enumerate(words)))).alias(*words))
    runs = F.array(*(F.struct(F.lit(n).alias("n"), F.concat(*[x for w in words[:n] for x in (F.lit(" "), F.col(w))][1:]).alias("gram")) for n in orders))
    return places.select(F.explode(runs).alias("g")).filter("g.gram is not null").groupBy(F.col("g.n").alias("ngram_order"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def prune_ngrams(counts: DataFrame, thresholds: str = "0|8|9") -> DataFrame:
    """Without n-grams whose count is at most the threshold of their order; the last threshold holds for higher orders."""
    limits = [int(x) for x in thresholds.split("|")]
    limit = F.lit(limits[-1])
    for n, x in enumerate(limits[:-1], start=1):
        limit = F.when(F.col("ngram_order") == n, x).otherwise(limit)
    return counts.filter(F.col("n") > limit)


def char_vocabulary(df: DataFrame, text: Column, delimiter: str = "|", extra: tuple[str, ...] = ("[UNK]", "[PAD]")) -> DataFrame:
    """Distinct characters in order with ids; the space becomes the delimiter, special tokens come last."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("c")).filter("c <> ''").distinct()
    # one row of as many elements as there are distinct characters
    ordered = chars.agg(F.array_sort(F.collect_list(F.struct(F.hex("c").alias("h"), F.col("c").alias("c")))).alias("o"))
    named = F.transform("o", lambda x: F.when(x["c"] == " ", F.lit(delimiter)).otherwise(x["c"]))
    return ordered.select(F.posexplode(F.concat(named, F.array(*map(F.lit, extra)))).alias("id", "token")).select("token", F.col("id").cast("long").alias("id"))


def vocabulary_except(tokens: DataFrame, known: DataFrame, token: str) -> DataFrame:
    """Distinct tokens that another vocabulary has not; nulls are no tokens."""
    return tokens.select(token).filter(F.col(token).isNotNull()).distinct().join(known.select(token).distinct(), token, "left_anti")


def top_n_per_label(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first rows of each label. Only rows that can be among them survive a partial step in each partition."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def other_class(df: DataFrame, label: str, listed: list[str], n: int, order: Column, other: str = "other") -> DataFrame:
    """Rows of labels that are not listed, relabelled, as many as ``n`` for each listed label."""
    return df.filter(~F.col(label).isin(listed)).withColumn(label, F.lit(other)).orderBy(order).limit(n * len(listed))


def train_dev_split(df: DataFrame, order: str | list[str], dev_size: int) -> DataFrame:
    """The first ``dev_size`` rows by the ``order`` columns (nulls first) are for development; fewer rows are an error.

    The cut is found by a top-k, so rows stay where they are. Rows that no order column tells apart stay
    together: those at the cut are all for development.
    """
    key = F.struct(*([order] if isinstance(order, str) else order))
    cut = df.select(key.alias("k")).orderBy("k").limit(dev_size).agg(F.max("k").alias("cut"), F.count(F.lit(1)).alias("have"))
    checked = cut.select("cut", F.when(F.col("have") < dev_size, F.raise_error(F.lit("fewer rows than the development set needs"))).otherwise(F.lit(0)).cast("int").alias("ok"))
    return df.join(F.broadcast(checked)).withColumn("split", F.when((key <= F.col("cut")) & (F.col("ok") == 0), "dev").otherwise("train")).drop("cut", "ok")


def mix_corpora(parts: list[DataFrame], limit: int, order: str) -> DataFrame:
    """An equal share of each corpus."""
    share = limit // len(parts)
    out = None
    for p in parts:
        some = p.orderBy(order).limit(share)
        out = some if out is None else out.unionByName(some)
    return out


def upsample(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def punctuation_labels(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row for each word: position, word in lower case, label of punctuation behind it and of its first letter's case."""
    words = F.filter(F.split(F.col(text), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")
    rows = df.select(*keys, F.posexplode(words).alias("pos", "original"))
    stripped = drop_punctuation(F.col("original"))
    last = F.substring("original", -1, 1)
    mark = F.when(last.isin(",", ".", "?"), last).otherwise("O")
    case = F.when(stripped.rlike(r"^\p{Lu}"), "U").otherwise("O")
    return rows.select(*keys, "pos", "original", F.lower(stripped).alias("word"), F.concat(mark, case).alias("label")).filter("word <> ''")


def batch_words(labels: DataFrame, key: str, pos: str, size: int) -> DataFrame:
    """Words and labels in lines of ``size`` words, within each key."""
    w = Window.partitionBy(key).orderBy(pos)
    return _lines(labels.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size)), [key], pos)


def batch_corpus(labels: DataFrame, key: str, pos: str, size: int) -> DataFrame:
    """Words and labels in lines of ``size`` words through the whole corpus, across borders of keys (numbers) and texts; the last one may be short."""
    rows = number_rows(labels, F.col(key), [pos], "row")
    return _lines(rows.withColumn("batch", F.floor(F.col("row") / size)), [], "row")


def _lines(batched: DataFrame, keys: list[str], pos: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(pos, "word", "label")))
    return batched.groupBy(*keys, "batch").agg(ordered.alias("o")).select(*keys, "batch", F.array_join(F.transform("o", lambda x: x["word"]), " ").alias("text"), F.array_join(F.transform("o", lambda x: x["label"]), " ").alias("labels"))


def worker_range(n: Column, workers: int, worker: int) -> Column:
    """Begin and end of a worker's contiguous share."""
    per = F.ceil(n / workers)
    return F.struct((per * worker).alias("begin"), F.least(per * (worker + 1), n).alias("end"))


def log_uniform(low: float, high: float, seed: int) -> Column:
    import math

    return F.exp(F.rand(seed) * (math.log(high) - math.log(low)) + math.log(low))
