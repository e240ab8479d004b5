"""Licence scans with a positional index of rare words (operator 4).

Licence templates are word sequences. The words of all templates get an inverse document frequency
over the whole corpus. Each template has postings (template, position) of its positions of highest
IDF, so many that a place with the asked share of the template's words has two of them at least; an
occurrence at place p of a word with position q votes for the template to begin at p - q. Where the
words at a relative position with two votes reach a share of the template, its mandatory key phrases
are verified there word by word, and the template's label is given. Three base phrases are found wherever their words stand consecutively; they are looked up
by their rarest word and verified in full, whatever the IDF.

Null and empty texts have 0 words, no places and empty labels. Repeated rows give repeated results; a table
without rows gives none. Columns besides those named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Beginnings of well-known licence texts and notices, with mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "is hereby granted"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER) if not (text or "").isascii() else (text or "").lower())


class LicenceIndex:
    """Postings of the templates' words, and the IDF that orders them."""

    def __init__(self, counts: dict[str, int], total: int, share: float = 0.6):
        self.share = share
        self.templates = [(label, t.split(), [k.split() for k in keys]) for label, t, keys in TEMPLATES]
        self.base = [(p.split(), label) for p, label in BASE.items()]
        self.vocab = frozenset(w for _, t, _ in self.templates for w in t) | {w for p, _ in self.base for w in p}
        self.idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in self.vocab}
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, seq, _) in enumerate(self.templates):
            # all but ``need`` words may differ at a place, so two of the rarest positions are met there whatever else the file has
            need = next(h for h in range(len(seq) + 1) if h / len(seq) >= share)
            rare = sorted(range(len(seq)), key=lambda q, seq=seq: (-self.idf[seq[q]], q))[: len(seq) - need + 2]
            for q in sorted(rare):
                self.postings[seq[q]].append((t, q))
        self.anchors = [max(range(len(p)), key=lambda i, p=p: (self.idf[p[i]], -i)) for p, _ in self.base]

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of base phrases, and labels with the share of the template that was found."""
        present = self.vocab.intersection(words)
        places: list[tuple[int, str]] = []
        scores: dict[str, float] = {}
        if not present:
            return places, scores
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        for (phrase, label), k in zip(self.base, self.anchors, strict=True):
            for p in at.get(phrase[k], ()):
                if p >= k and words[p - k : p - k + len(phrase)] == phrase:
                    places.append((p - k, label))
                    scores[label] = 1.0
        votes: Counter = Counter()
        for w, places_of in at.items():
            for t, q in self.postings.get(w, ()):
                for p in places_of:
                    votes[t, p - q] += 1
        for (t, start), n in votes.items():
            label, seq, keys = self.templates[t]
            if scores.get(label, 0) >= 1.0 or n < 2:
                continue
            found = words[max(0, start) : start + len(seq)]
            hit = sum(1 for i, w in enumerate(seq) if 0 <= start + i < len(words) and words[start + i] == w) / len(seq)
            if hit >= self.share and all(any(found[i : i + len(k)] == k for i in range(len(found) - len(k) + 1)) for k in keys):
                scores[label] = max(scores.get(label, 0), hit)
        return places, scores


def licence_word_counts(df: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, over all documents; at most one count for each word of the templates."""
    vocab = LicenceIndex({}, 0).vocab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(vocab.intersection(words_of(text.as_py())))
                counts[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document."""
    counts, total = licence_word_counts(df, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenceIndex(counts, total)
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, scores = index.scan(words)
                starts = [p for p, _ in places]
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(scores)), max(scores.values(), default=0.0))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
