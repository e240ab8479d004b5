"""Toxicity scores from subword-bag embeddings (operator 1).

A word is the mean of the embeddings of its character n-grams (hashed into a table), a document the
mean of its words, and a linear softmax over two classes reads it; embeddings and softmax are
trained together in numpy. Misspelt or inflected words share n-grams with those seen in training.

The fit uses a bounded sample of labelled rows (``max_rows`` of each class, texts of at most
``max_row_chars`` characters and ``max_chars`` in all, chosen by a hash of the id), weighted back to the classes' shares among all labels. Only the
text is an input of a score.

Null and empty texts score as the prior says. Without labels of both classes every score is 0. A null id
is never in the fit and counts as held out. Repeated rows score alike.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.memory import give_back

#: Letters and digits, with signs inside that misspellings put for letters.
WORD = re.compile(r"[^\W_]+(?:['’*@$!_-]+[^\W_]+)*")
#: Letters of a word whose n-grams are held at once.
STRETCH = 20_000
#: Texts of the fit whose n-grams are worked out at once.
AT_ONCE = 25


@dataclass(frozen=True)
class ToxicityParams:
    buckets: int = 1 << 17
    dim: int = 4
    shortest: int = 3
    longest: int = 6
    min_docs: int = 8
    min_z: float = 5.0
    scale: float = 100.0
    epochs: int = 100
    rate: float = 0.05
    decay: float = 3e-5
    max_rows: int = 2000
    max_row_chars: int = 4000
    max_chars: int = 5_000_000
    threshold: float = 0.3
    seed: int = 7


def ngram_ids(word: str, p: ToxicityParams) -> list[int]:
    """Table rows of a word's n-grams and of the whole word."""
    w = f"<{word}>"
    raw = [w, *(w[i : i + n] for n in range(p.shortest, p.longest + 1) for i in range(len(w) - n + 1))]
    return [crc32(x.encode()) % p.buckets for x in raw]


class ToxicityModel:
    """Trained weights. For scoring, the linear softmax folds into one number for each n-gram."""

    def __init__(self, params: ToxicityParams, weight: np.ndarray | None, bias: float):
        self.params, self.weight, self.bias = params, weight, bias
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        """Mean weight of a word's n-grams; a long word's are summed a stretch at a time."""
        p = self.params
        if len(w) <= STRETCH:
            return float(self.weight[ngram_ids(w, p)].mean())
        full = f"<{w}>"
        total, n = float(self.weight[crc32(full.encode()) % p.buckets]), 1
        for at in range(0, len(full), STRETCH):
            ids = [crc32(full[i : i + k].encode()) % p.buckets for k in range(p.shortest, p.longest + 1) for i in range(at, min(at + STRETCH, len(full) - k + 1))]
            total += float(self.weight[ids].sum()) if ids else 0.0
            n += len(ids)
        return total / n

    def score(self, text: str | None) -> float:
        if self.weight is None:
            return 0.0
        words = WORD.findall((text or "").lower())
        total = 0.0
        if words:
            known = self.known
            if len(known) > 300_000:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.word(w)
            total = sum(map(known.__getitem__, words)) / len(words)
        return float(1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40))))


def _design(texts: list[str], y: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, table row and weight of each n-gram in a document's mean of word means.

    N-grams in fewer than ``min_docs`` documents, or about as often in one class as in the other, are left out.
    """
    vocab: dict[str, int] = {}
    grams, ends = array("l"), array("l", [0])
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bad, good = np.zeros(p.buckets), np.zeros(p.buckets)
    for first in range(0, len(texts), AT_ONCE):
        doc, word = array("l"), array("l")
        for i, t in enumerate(texts[first : first + AT_ONCE]):
            for w in WORD.findall((t or "").lower()):
                if w not in vocab:
                    vocab[w] = len(vocab)
                    grams.extend(ngram_ids(w, p))
                    ends.append(len(grams))
                doc.append(i)
                word.append(vocab[w])
        d, w = np.array(doc, np.int64), np.array(word, np.int64)
        size = np.bincount(d, minlength=AT_ONCE)
        pair, times = np.unique(d * max(1, len(vocab)) + w, return_counts=True)
        d, w = pair // max(1, len(vocab)), pair % max(1, len(vocab))
        edge = np.frombuffer(ends, np.int64)
        n = edge[w + 1] - edge[w]
        at = np.repeat(edge[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(d, n) * p.buckets + np.frombuffer(grams, np.int64)[at]
        del edge, at
        cell, where = np.unique(cell, return_inverse=True)
        weight = np.bincount(where, np.repeat(times / size[d] / n, n), len(cell))
        d, gram = (first + cell // p.buckets).astype(np.int32), (cell % p.buckets).astype(np.int32)
        bad += np.bincount(gram, y[d], p.buckets)
        good += np.bincount(gram, 1 - y[d], p.buckets)
        parts.append((d, gram, weight.astype(np.float32)))
    del vocab, grams, ends
    odds = np.log((bad + 0.5) / (y.sum() - bad + 0.5)) - np.log((good + 0.5) / ((1 - y).sum() - good + 0.5))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (y.sum() - bad + 0.5) + 1 / (good + 0.5) + 1 / ((1 - y).sum() - good + 0.5))
    keep = (bad + good >= p.min_docs) & (np.abs(odds) >= p.min_z * spread)
    # block by block, so that what is left out is never held twice
    for k, part in enumerate(parts):
        mine = keep[part[1]]
        parts[k] = tuple(x[mine] for x in part)
    doc, gram, weight = (np.concatenate([x[k] for x in parts]) for k in range(3))
    return doc, gram, weight


def train(texts: list[str], labels: list[int], weights: list[float], p: ToxicityParams) -> ToxicityModel:
    """Fit embeddings and softmax together by Adam on the whole sample."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return ToxicityModel(p, None, 0.0)
    sample_weight = np.array(weights, np.float32)
    sample_weight /= sample_weight.sum()
    doc, gram, value = _design(texts, y, p)
    used, gram = np.unique(gram, return_inverse=True)
    value = p.scale * value
    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.1, (len(used), p.dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32)
    prior = float((sample_weight * y).sum())
    bias = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    for step in range(1, p.epochs + 1):
        doc_vec = np.stack([np.bincount(doc, value * emb[gram, d], len(y)) for d in range(p.dim)], 1)
        z = doc_vec @ soft + bias
        z -= z.max(axis=1, keepdims=True)
        err = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        err[np.arange(len(y)), y] -= 1
        err *= sample_weight[:, None]
        to_doc = err @ soft.T
        to_emb = np.stack([np.bincount(gram, value * to_doc[doc, d], len(used)) for d in range(p.dim)], 1)
        for x, g, (m, v) in zip((emb, soft, bias), (to_emb + p.decay * emb, doc_vec.T @ err + p.decay * soft, err.sum(axis=0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= (p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    weight = np.zeros(p.buckets, np.float32)
    weight[used] = p.scale * (emb @ (soft[:, 1] - soft[:, 0]))
    return ToxicityModel(p, weight, float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """Rows that no fit sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_toxicity(documents: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """Train on labelled documents outside the held-out fold."""
    p = params or ToxicityParams()
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel(p, None, 0.0)
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(p.max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * max_rows ids, whatever the corpus
    short = documents.select("doc_id", "text").filter(F.length("text") <= p.max_row_chars)
    rows = short.join(F.broadcast(chosen), "doc_id").select("toxic", "text", order.alias("o"))
    picked, chars = [], 0
    for r in rows.orderBy("o", "text").limit(4 * p.max_rows).toLocalIterator():
        if chars + len(r["text"]) <= p.max_chars:
            picked.append(r)
            chars += len(r["text"])
    seen = {y: sum(r["toxic"] == y for r in picked) for y in (0, 1)}
    if not all(seen.values()):
        return ToxicityModel(p, None, 0.0)
    model = train([r["text"] for r in picked], [r["toxic"] for r in picked], [counts[r["toxic"]] / seen[r["toxic"]] for r in picked], p)
    # the driver goes on with other stages
    del picked
    give_back()
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel, out: str = "toxicity", text_col: str = "text") -> DataFrame:
    """Add a score column to a table; all its columns stay, but for one of that name."""
    documents = documents.drop(*(c for c in documents.columns if c.lower() == out.lower()))
    packed = documents.sparkSession.sparkContext.broadcast((model.params, None if model.weight is None else model.weight.tobytes(), model.bias))
    at = documents.columns.index(text_col)
    made: dict[int, ToxicityModel] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in made:
            params, raw, bias = packed.value
            made[0] = ToxicityModel(params, None if raw is None else np.frombuffer(raw, np.float32), bias)
        for batch in batches:
            scores = [made[0].score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    from pyspark.sql.types import DoubleType, StructType

    return documents.mapInArrow(run, StructType(list(documents.schema.fields)).add(out, DoubleType()))


def toxicity_report(documents: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    p = params or ToxicityParams()
    scored = score_toxicity(documents.select("doc_id", "text"), fit_toxicity(documents, labels, p), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
