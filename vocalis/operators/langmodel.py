"""N-gram models with modified Kneser-Ney smoothing of any order, and beam search with such a model.

Sentences are framed by ``<s>`` and ``</s>``. Below the highest order an n-gram counts as often as words (``<s>`` among
them) stand before it, but for n-grams that begin with ``<s>``. Each order has three discounts, from how many n-grams
count once to four times; where these give none the fixed ones. An n-gram whose plain count is at most its order's threshold is
left out, and what it counted goes to its context's back-off weight. Unigrams are interpolated with an even share for all words,
``</s>`` and ``<unk>``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: Discounts where counts of counts give none: of n-grams that count once, twice, and more often.
FALLBACK = (0.5, 1.0, 1.5)


def sentence_grams(df: DataFrame, tokens: Column, order: int) -> DataFrame:
    """``ngram_order, gram, n`` of sentences given as arrays of words: how often each run of words is there, ``<s>`` and ``</s>`` included.

    A null sentence has no words.
    """
    said = F.coalesce(F.filter(tokens, lambda w: w.isNotNull() & (w != "")), F.array().cast("array<string>"))
    framed = df.select(F.concat(F.array(F.lit(BEGIN)), said, F.array(F.lit(END))).alias("t"))
    words = [f"w{k}" for k in range(order)]
    # a row for each place with the words from there on, null behind the end
    places = framed.select(F.inline(F.arrays_zip(*(F.slice("t", k + 1, F.size("t")).alias(w) for k, w in enumerate(words)))).alias(*words))
    runs = F.array(*(F.struct(F.lit(n).alias("o"), F.concat(*[x for w in words[:n] for x in (F.lit(" "), F.col(w))][1:]).alias("gram")) for n in range(1, order + 1)))
    grams = places.select(F.explode(runs).alias("g")).filter("g.gram is not null")
    return grams.groupBy(F.col("g.o").alias("ngram_order"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Discounts from how many n-grams count once, twice, three and four times."""
    t1, t2, t3, t4 = counts_of_counts
    if not (t1 and t2 and t3):
        return FALLBACK
    y = t1 / (t1 + 2 * t2)
    found = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, t1, t2), (2, t2, t3), (3, t3, t4)))
    return found if all(0 <= d <= k for k, d in zip((1, 2, 3), found, strict=True)) else FALLBACK


def _thresholds(prune: str, order: int) -> list[int]:
    limits = [int(x) for x in prune.split("|")]
    limits += limits[-1:] * (order - len(limits))
    if limits[0] != 0 or sorted(limits) != limits:
        raise ValueError("thresholds begin with 0 and do not fall")
    return limits[:order]


def modified_kneser_ney(counts: DataFrame, order: int, prune: str = "0") -> DataFrame:
    """``ngram_order, gram, log10p, backoff`` from ``ngram_order, gram, n`` of all orders up to ``order``; ``backoff`` is null in the highest.

    A table without n-grams gives ``<unk>`` alone. N-grams are counted once, at once, and lie on the executors' disks
    with their adjusted counts as long as the model is in use.
    """
    limits = _thresholds(prune, order)
    n = F.col("ngram_order")
    before, suffix = (F.when(n > 1, F.expr(f"substring_index(gram, ' ', {k})")).otherwise("") for k in ("ngram_order - 1", "1 - ngram_order"))
    raw = counts.filter(n <= order).select("ngram_order", "gram", "n").localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    after = raw.filter(n > 1).groupBy((n - 1).alias("ngram_order"), suffix.alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
    framed = F.substring_index("gram", " ", 1) == BEGIN
    limit = F.element_at(F.array(*map(F.lit, limits)), n)
    adjusted = F.when((n == order) | framed, F.col("n")).otherwise(F.coalesce("kinds", F.lit(0)))
    every = raw.join(after, ["ngram_order", "gram"], "left").filter(F.col("gram") != BEGIN)
    every = every.select("ngram_order", "gram", adjusted.alias("a"), (F.col("n") <= limit).alias("gone")).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    every = every.withColumns({"context": before, "suffix": suffix})
    # four counts for each order
    seen = {r.ngram_order: [r.t1, r.t2, r.t3, r.t4] for r in every.groupBy("ngram_order").agg(*(F.sum((F.col("a") == k).cast("long")).alias(f"t{k}") for k in range(1, 5))).collect()}
    table = F.array(*(F.array(F.lit(0.0), *map(F.lit, discounts(seen.get(k, [0] * 4)))) for k in range(1, order + 1)))
    every = every.withColumn("d", F.element_at(F.element_at(table, n), (F.least("a", F.lit(3)) + 1).cast("int")))
    taken = F.when(F.col("gone"), F.col("a")).otherwise(F.col("d"))
    weights = every.groupBy("ngram_order", "context").agg(F.sum("a").cast("double").alias("total"), F.sum(taken).alias("taken")).withColumn("gamma", F.when(F.col("total") > 0, F.col("taken") / F.col("total")).otherwise(1.0))
    own = every.filter(~F.col("gone")).join(weights, ["ngram_order", "context"]).select("ngram_order", "gram", "suffix", "gamma", F.when(F.col("total") > 0, (F.col("a") - F.col("d")) / F.col("total")).otherwise(0.0).alias("u"))
    # one row: how many words there are, and what is left for each
    spare = every.filter(n == 1).agg(F.count(F.lit(1)).alias("words"), F.sum("a").alias("total"), F.sum("d").alias("taken"))
    even = spare.select((F.when(F.col("total") > 0, F.col("taken") / F.col("total")).otherwise(1.0) / (F.col("words") + 1)).alias("even"))
    ones = own.filter(n == 1).join(F.broadcast(even)).select("ngram_order", "gram", (F.col("u") + F.col("even")).alias("p"))
    ones = ones.unionByName(even.select(F.lit(1).alias("ngram_order"), F.lit(UNKNOWN).alias("gram"), F.col("even").alias("p")))
    levels = [ones]
    for k in range(2, order + 1):
        shorter = levels[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        levels.append(own.filter(n == k).join(shorter, "suffix").select("ngram_order", "gram", (F.col("u") + F.col("gamma") * F.col("q")).alias("p")))
    begin = every.sparkSession.range(1).select(F.lit(1).alias("ngram_order"), F.lit(BEGIN).alias("gram"), F.lit(1.0).alias("p"))
    out = begin
    for level in levels:
        out = out.unionByName(level)
    back = weights.filter(n > 1).select((n - 1).alias("ngram_order"), F.col("context").alias("gram"), F.col("gamma"))
    backoff = F.when(n < order, F.coalesce(F.log10("gamma"), F.lit(0.0)))
    return out.join(back, ["ngram_order", "gram"], "left").select("ngram_order", "gram", F.log10("p").alias("log10p"), backoff.alias("backoff"))


def only_words(model: DataFrame, words: DataFrame) -> DataFrame:
    """N-grams all of whose words are in ``words`` (a column ``word``) or are marks, as they are."""
    marks = F.array(*map(F.lit, (BEGIN, END, UNKNOWN)))
    rows = model.withColumn("words", F.split("gram", " "))
    needed = rows.select("ngram_order", "gram", F.explode(F.array_distinct("words")).alias("word")).filter(~F.array_contains(marks, F.col("word")))
    missing = needed.join(words.select("word").distinct(), "word", "left_anti").select("ngram_order", "gram").distinct()
    return rows.join(missing, ["ngram_order", "gram"], "left_anti").select(*model.columns)


def gram_hash(gram: str) -> int:
    """The hash of an n-gram, as Spark's ``xxhash64`` has it."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class HashedModel:
    """A model as arrays: sorted hashes of n-grams, their log10 probabilities and back-off weights; and its words, in order."""

    keys: np.ndarray
    log10p: np.ndarray
    backoff: np.ndarray
    words: list[str]
    order: int

    def _find(self, gram: tuple[str, ...]) -> int:
        key = gram_hash(" ".join(gram))
        i = int(np.searchsorted(self.keys, key))
        return i if i < len(self.keys) and self.keys[i] == key else -1

    def score(self, history: tuple[str, ...], word: str) -> float:
        """log10 of the word's probability after the history."""
        context = history[len(history) - self.order + 1 :] if len(history) >= self.order else history
        if self._find((word,)) < 0:
            word = UNKNOWN
        out = 0.0
        while True:
            i = self._find((*context, word))
            if i >= 0:
                return out + float(self.log10p[i])
            if not context:
                return out - 99.0  # a model without <unk>
            i = self._find(context)
            out += float(self.backoff[i]) if i >= 0 else 0.0
            context = context[1:]


def hashed_model(model: DataFrame, most: int = 20_000_000) -> HashedModel:
    """The model as arrays for decoding. Every task holds them, so a model of more than ``most`` n-grams (24 bytes each) is refused:
    prune it more, or keep fewer words (``only_words``)."""
    n = model.count()
    if n > most:
        raise ValueError(f"the model has {n} n-grams, tasks may hold {most}")
    rows = model.select(F.xxhash64("gram").alias("key"), "log10p", F.coalesce("backoff", F.lit(0.0)).alias("backoff"), "ngram_order", F.when(F.col("ngram_order") == 1, F.col("gram")).alias("word")).toArrow()
    key = rows.column("key").to_numpy()
    at = np.argsort(key, kind="stable")
    words = sorted(w for w in rows.column("word").to_pylist() if w is not None and w not in (BEGIN, END, UNKNOWN))
    order = max(rows.column("ngram_order").to_pylist(), default=1)
    return HashedModel(key[at], rows.column("log10p").to_numpy()[at], rows.column("backoff").to_numpy()[at], words, order)


class Lexicon:
    """Which symbols may follow the beginning of a word so that it still begins a known word."""

    def __init__(self, words: list[str], letters: list[str]):
        self.letters = letters
        self.words = set(words)
        self.next: dict[str, np.ndarray] = {}
        begins: dict[str, set[str]] = {}
        for w in self.words:
            for i in range(len(w)):
                begins.setdefault(w[:i], set()).add(w[i])
        self.begins = begins

    def follow(self, part: str) -> np.ndarray:
        if part not in self.next:
            some = self.begins.get(part, set())
            self.next[part] = np.array([x in some for x in self.letters])
        return self.next[part]


@dataclass
class Scoring:
    """How acoustic and language scores are added: ``alpha`` times the natural logarithm of each word's probability and ``beta`` for it;
    ``unknown`` for a word that the model lacks, and already for its beginning when no known word begins so. ``boundary``: the model scores the end too."""

    alpha: float = 1.0
    beta: float = 0.5
    unknown: float = -10.0
    boundary: bool = True


def beam_search(logp: np.ndarray, letters: list[str], blank: int, width: int, model: HashedModel | None, lexicon: Lexicon | None, how: Scoring) -> list[tuple[str, float, float]]:
    """The best texts of frames of log probabilities with their total and acoustic scores.

    Beams are arrays: log probability ending in a blank and in the last symbol, language score, last symbol. Words are between spaces;
    spaces at the ends or next to each other make none.
    """
    space = letters.index(" ") if " " in letters else -1
    texts, part, history = [""], [""], [(BEGIN,)]
    in_blank, in_symbol = np.zeros(1), np.full(1, -np.inf)
    language, pending = np.zeros(1), np.zeros(1)
    last = np.full(1, -1)
    word_cost: dict[tuple[tuple[str, ...], str], float] = {}

    def word(h: tuple[str, ...], w: str) -> float:
        if (h, w) not in word_cost:
            oov = how.unknown if w not in lexicon.words else 0.0
            word_cost[h, w] = how.alpha * math.log(10) * model.score(h, w) + how.beta + oov
        return word_cost[h, w]

    def close(i: int) -> float:
        return word(history[i], part[i]) if model is not None and part[i] else 0.0

    columns = np.array([c for c in range(len(letters)) if c != blank])
    for row in logp:
        n = len(texts)
        total = np.logaddexp(in_blank, in_symbol)
        stay_blank = total + row[blank]
        stay_symbol = np.where(last >= 0, in_symbol + row[np.maximum(last, 0)], -np.inf)
        grow = np.where(columns[None, :] == last[:, None], in_blank[:, None], total[:, None]) + row[columns][None, :]
        # an extension that is a beam already is added to it
        at = {t: i for i, t in enumerate(texts)}
        for j, t in enumerate(texts):
            if t and (i := at.get(t[:-1])) is not None:
                k = int(np.flatnonzero(columns == last[j])[0])
                stay_symbol[j] = np.logaddexp(stay_symbol[j], grow[i, k])
                grow[i, k] = -np.inf
        new_language = np.repeat(language[:, None], len(columns), 1)
        new_pending = np.zeros_like(new_language)
        if model is not None:
            for i in range(n):
                new_pending[i] = np.where(lexicon.follow(part[i])[columns], 0.0, how.unknown)
                if space >= 0:
                    k = int(np.flatnonzero(columns == space)[0])
                    new_language[i, k], new_pending[i, k] = language[i] + close(i), 0.0
        score = np.r_[np.logaddexp(stay_blank, stay_symbol) + language + pending, (grow + new_language + new_pending).ravel()]
        best = np.argsort(-score, kind="stable")[:width]
        best = best[score[best] > -np.inf]
        kept, made = best[best < n], best[best >= n] - n
        i, k = made // len(columns), made % len(columns)
        new_texts, new_part, new_history = [texts[x] for x in kept], [part[x] for x in kept], [history[x] for x in kept]
        for a, c in zip(i.tolist(), columns[k].tolist(), strict=True):
            new_texts.append(texts[a] + letters[c])
            closed = c == space
            new_part.append("" if closed else part[a] + letters[c])
            keep = model.order - 1 if model is not None else 0
            new_history.append(((*history[a], part[a])[-keep:] if keep else ()) if closed and part[a] else history[a])
        in_blank = np.r_[stay_blank[kept], np.full(len(made), -np.inf)]
        in_symbol = np.r_[stay_symbol[kept], grow[i, k]]
        language, pending = np.r_[language[kept], new_language[i, k]], np.r_[pending[kept], new_pending[i, k]]
        last = np.r_[last[kept], columns[k]]
        texts, part, history = new_texts, new_part, new_history
    acoustic = np.logaddexp(in_blank, in_symbol)
    out = []
    for i, text in enumerate(texts):
        score = float(acoustic[i] + language[i]) + close(i)
        if model is not None and how.boundary:
            keep = model.order - 1
            ended = (*history[i], part[i])[-keep:] if part[i] and keep else history[i] if keep else ()
            score += how.alpha * math.log(10) * model.score(ended, END)
        out.append((text, score, float(acoustic[i])))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def decode_beams(frames: DataFrame, keys: list[str], frame: str, logits: str, vocab: list[str], model: HashedModel | None = None, blank: int = 0, width: int = 100, n_best: int = 1, how: Scoring | None = None, delimiter: str = "|") -> DataFrame:
    """The best beams of each key's frames: ``keys, rank, text, score, acoustic``. Frames of a key pass to one task in order, as one signal."""
    letters = [" " if v == delimiter else v for v in vocab]
    if any(len(x) != 1 for i, x in enumerate(letters) if i != blank):
        raise ValueError("symbols other than the blank are single letters")
    how = how or Scoring()
    session = frames.sparkSession
    sent = session.sparkContext.broadcast(model)
    kinds = dict(frames.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    rows = frames.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(frame).alias("frame"), F.col(logits).cast("array<double>").alias("x"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "frame").drop("frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = sent.value
        lexicon = Lexicon(lm.words, letters) if lm is not None else None
        current, held, types = None, [], []

        def done() -> pa.RecordBatch:
            x = np.array(held)
            x = x - x.max(axis=1, keepdims=True)
            logp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
            best = beam_search(logp, letters, blank, width, lm, lexicon, how)[:n_best]
            texts, scores, acoustic = zip(*best, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(best), t) for k, t in zip(current, types, strict=True)), pa.array(range(len(best)), pa.int32()), pa.array(texts), pa.array(scores), pa.array(acoustic)], names=[*names, "rank", "text", "score", "acoustic"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(names))]
            for *key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if current is not None:
                        yield done()
                    current, held = key, []
                held.append(x)
        if current is not None:
            yield done()

    out = rows.mapInArrow(run, ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True)), "rank int, text string, score double, acoustic double"]))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "rank", "text", "score", "acoustic")
