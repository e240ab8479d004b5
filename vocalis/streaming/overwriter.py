"""Speech streams to text with a model that reads a chunk in segments and may take back what it said.

Each chunk is transcribed anew, but the words that the last transcript placed in it are known: the model is given most of them as
its beginning (``prefix``), all but the last few, which it may change. What goes out for a chunk is the text to
remove from the end of the transcript and the segments that follow instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vocalis.streaming.chunker import STATE as CHUNKS
from vocalis.streaming.chunker import Chunker

Segment = tuple[float, float, str]
#: From samples, a prompt and a prefix to segments: seconds within the samples and text, which begins with the prefix.
Model = Callable[[np.ndarray, str | None, str | None], list[Segment]]

SEGMENT = "struct<start:double,end:double,text:string>"
OUT = f"message_id string, response long, frame_idx long, remove string, append string, end double, segments array<{SEGMENT}>, end_of_message boolean"
COLUMNS = [c.split()[0] for c in ("message_id", "response", "frame_idx", "remove", "append", "end", "segments", "end_of_message")]


def word_times(start: float, end: float, n: int) -> list[float]:
    """Times of n words spread evenly from start to end; one word stands in the middle."""
    return np.linspace(start, end, n).tolist() if n > 1 else [(start + end) / 2] * n


def words_since(segments: list[Segment], second: float) -> list[str] | None:
    """Words of the segments that end at ``second`` or later, as far as they are placed there; None without such a segment."""
    inside = [s for s in segments if s[1] >= second]
    if not inside:
        return None
    out = []
    for start, end, text in inside:
        words = [w for w in text.split(" ") if w]
        out += [w for w, t in zip(words, word_times(start, end, len(words)), strict=True) if t >= second]
    return out


def repetitive(text: str, ratio: float = 2.0) -> bool:
    """Whether a text compresses so well that it is no transcript."""
    raw = text.encode()
    return len(raw) / len(zlib.compress(raw)) > ratio


class Overwriter:
    """The rule for one message. ``open`` are the segments of the last chunk that had any, ``sent`` the number of responses."""

    def __init__(self, model: Model, chunker: Chunker, rate: int, redo: int = 3, least_prefix: int = 2, sound: str = "[A-Z]"):
        self.model, self.chunker, self.rate, self.redo, self.least_prefix, self.sound = model, chunker, rate, redo, least_prefix, re.compile(sound)
        self.open: list[Segment] = []
        self.sent = 0

    def feed(self, frame_idx: int, piece: list[float], end: bool) -> list[tuple]:
        """Responses (number, first sample of the chunk, remove, append, end of the first segment, further segments, last)."""
        out = []
        for at, samples, last in self.chunker.feed(frame_idx, piece, end):
            second = at / self.rate
            known = words_since(self.open, second)
            remove = prefix = prompt = None
            if known is not None:
                remove = " ".join(known)
                prefix = " ".join(known[: max(self.least_prefix, len(known) - self.redo)])
                prefix = None if repetitive(prefix) else prefix
            elif self.open:
                prompt = self.open[-1][2]
            found = [(s + second, e + second, t) for s, e, t in self.model(np.asarray(samples), prompt, prefix)]
            if found:
                (_, first_end, append), more = found[0], [s for s in found[1:] if self.sound.search(s[2])]
                self.open = [(second, first_end, append), *more]
                out.append((self.sent, at, remove, append, first_end, more, last))
                self.sent += 1
        if end:
            self.open, self.sent = [], 0
        return out


def _row(message_id: str, response: tuple) -> tuple:
    number, at, remove, append, end, more, last = response
    return message_id, number, at, remove, append, end, [dict(zip(("start", "end", "text"), s, strict=True)) for s in more], last


class OverwriteProcessor(StatefulProcessor):
    """Three states for each message: the samples in hand, the open segments and how many responses went out."""

    def __init__(self, load: Callable[[], Model], rate: int, chunking: tuple, redo: int):
        self.load, self.rate, self.chunking, self.redo = load, rate, chunking, redo

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = self.load()
        self.chunks = handle.getValueState("chunk", CHUNKS)
        self.open = handle.getListState("open", "start double, end double, text string")
        self.sent = handle.getValueState("sent", "responses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = Chunker(*self.chunking)
        rule = Overwriter(self.model, c, self.rate, self.redo)
        if self.chunks.exists():
            buffer, at, last, following = self.chunks.get()
            c.buffer, c.at, c.last, c.following = list(buffer), None if at < 0 else at, last, following
            rule.open = [tuple(s) for s in self.open.get()] if self.open.exists() else []
            rule.sent = self.sent.get()[0]
        out = []
        for r in pd.concat(list(rows)).sort_values(["frame_idx", "end_of_signal"], kind="stable").itertuples():
            out += [_row(key[0], x) for x in rule.feed(int(r.frame_idx), list(r.array), bool(r.end_of_signal))]
        if c.following == 0:
            self.chunks.clear()
            self.open.clear()
            self.sent.clear()
        else:
            self.chunks.update((c.buffer, -1 if c.at is None else c.at, c.last, c.following))
            self.sent.update((rule.sent,))
            if rule.open:
                self.open.put(rule.open)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def overwrite_stream(messages: DataFrame, load: Callable[[], Model], rate: int, size: int, step: int, least: int | None = None, most: int | None = None, redo: int = 3) -> DataFrame:
    """Streaming messages (message_id, frame_idx, array, end_of_signal) to responses that remove and append text."""
    return messages.groupBy("message_id").transformWithStateInPandas(OverwriteProcessor(load, rate, (size, step, least, most), redo), OUT, "Append", "None")


def overwrite_batch(messages: DataFrame, load: Callable[[], Model], rate: int, size: int, step: int, least: int | None = None, most: int | None = None, redo: int = 3) -> DataFrame:
    """The same rule over a batch table: sorted messages pass through a task as a stream, of which one chunk and its segments are held."""
    rows = messages.select("message_id", "frame_idx", "array", "end_of_signal").repartition("message_id").sortWithinPartitions("message_id", "frame_idx", "end_of_signal")
    segment = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(segment), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, current, rule = load(), None, None
        for batch in batches:
            out = []
            for message, at, array, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rule is None or message != current:
                    current, rule = message, Overwriter(model, Chunker(size, step, least, most), rate, redo)
                out += [_row(current, x) for x in rule.feed(at, array, end)]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS)

    return rows.mapInArrow(run, OUT)


def response_text(append: str = "append", segments: str = "segments") -> Column:
    """What a response appends: its first segment and the further ones."""
    return F.concat(F.col(append), F.array_join(F.transform(segments, lambda s: s["text"]), ""))


def _follow(text: str, remove: str | None, append: str) -> str:
    if remove and text.endswith(remove):
        text = text.replace(remove, "")
    return (text + append).replace("  ", " ")


def fold_responses(responses: DataFrame, keys: list[str], order: list[str], remove: str = "remove", append: str = "append") -> DataFrame:
    """``keys, text``: in order, what a row removes goes wherever it stands in the text so far, then the row's text is
    appended and two spaces become one. A text that does not end with what is to be removed stays. Null is nothing.

    Rows pass through a task as a stream, of which one text is held.
    """
    names = [f"k{i}" for i in range(len(keys))]
    kinds = dict(responses.dtypes)
    rows = responses.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(remove).alias("remove"), F.col(append).alias("append"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, *(f"o{i}" for i in range(len(order)))).select(*names, "remove", "append")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, text, types = None, "", []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(current, types, strict=True)), pa.array([text])], names=[*names, "text"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(names))]
            for *key, gone, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if current is not None:
                        yield done()
                    current, text = key, ""
                text = _follow(text, gone, more or "")
        if current is not None:
            yield done()

    folded = rows.mapInArrow(run, ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True)), "text string"]))
    return folded.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "text")


#: Added to the code point of a word's first letter.
WORD_START = 1 << 21


def spelled(words: list[str], hop: int) -> list[float]:
    """Samples that ``spelled_model`` reads: the code points of each word, filled up to ``hop`` by zeros."""
    return [float(c) for w in words for c in [ord(w[0]) + WORD_START, *map(ord, w[1:])] + [0] * (hop - len(w))]


def spelled_model(hop: int, rate: int, words: int = 4) -> Model:
    """A model that reads words off the samples, as a stand-in for one that hears them: it knows words that are there as a whole,
    begins with the prefix it is given, and makes a segment of so many words."""

    def model(samples: np.ndarray, prompt: str | None, prefix: str | None) -> list[Segment]:
        codes = samples.astype(np.int64)
        starts = [i for i in np.flatnonzero(codes >= WORD_START).tolist() if i + hop <= len(codes)]
        heard = [(i, "".join(chr(c % WORD_START) for c in codes[i : i + hop].tolist() if c)) for i in starts]
        if prefix:
            known = prefix.split(" ")
            last = max((n for n, (_, w) in enumerate(heard) if w in known), default=-1)
            heard = [(0, w) for w in known] + heard[last + 1 :]
        parts = [heard[a : a + words] for a in range(0, len(heard), words)]
        return [(part[0][0] / rate, (part[-1][0] + hop) / rate, "".join(f" {w}" for _, w in part)) for part in parts]

    return model
