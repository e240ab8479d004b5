"""Speech streams to text: overlapping chunks, a model on each, and what its transcript adds to the message."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vocalis.streaming.chunker import STATE as CHUNKS
from vocalis.streaming.chunker import Chunker
from vocalis.streaming.segmenter import Gluer

OUT = "message_id string, frame_idx long, letters string, times array<double>, end_of_message boolean"
COLUMNS = ["message_id", "frame_idx", "letters", "times", "end_of_message"]
#: From the samples of a chunk to letters and their seconds within it.
Model = Callable[[np.ndarray], tuple[str, list[float]]]


def ctc_model(logits: Callable[[np.ndarray], np.ndarray], vocabulary: list[str], rate: int, blank: int = 0, delimiter: str = "|") -> Model:
    """A model of samples to frame scores with greedy decoding: runs of a token count once, blanks not at all."""

    def model(samples: np.ndarray) -> tuple[str, list[float]]:
        best = logits(samples).argmax(axis=1)
        frames = np.flatnonzero((best != blank) & (np.diff(best, prepend=-1) != 0))
        letters = [vocabulary[i].replace(delimiter, " ") for i in best[frames].tolist()]
        return "".join(letters), (frames * (len(samples) / max(1, len(best)) / rate)).tolist()

    return model


class Transcriber:
    """The rule for one message. A chunk whose transcript has no letters, or none that match, adds nothing."""

    def __init__(self, model: Model, chunker: Chunker, gluer: Gluer, rate: int):
        self.model, self.chunker, self.gluer, self.rate = model, chunker, gluer, rate

    def feed(self, frame_idx: int, piece: list[float], end: bool) -> list[tuple[int, str, list[float], bool]]:
        out = []
        for at, samples, last in self.chunker.feed(frame_idx, piece, end):
            letters, times = self.model(np.asarray(samples))
            found = self.gluer.feed(letters, [t + at / self.rate for t in times]) if letters else None
            if found:
                out.append((at, *found, last))
        if end:
            self.gluer.letters, self.gluer.times = "", []
        return out


class TranscribeProcessor(StatefulProcessor):
    def __init__(self, load: Callable[[], Model], rate: int, chunking: tuple):
        self.load, self.rate, self.chunking = load, rate, chunking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = self.load()
        self.chunks = handle.getValueState("chunk", CHUNKS)
        self.glued = handle.getValueState("glued", "letters string, times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, g = Chunker(*self.chunking), Gluer()
        if self.chunks.exists():
            buffer, at, last, following = self.chunks.get()
            c.buffer, c.at, c.last, c.following = list(buffer), None if at < 0 else at, last, following
            letters, times = self.glued.get()
            g.letters, g.times = letters, list(times)
        rule, out = Transcriber(self.model, c, g, self.rate), []
        for r in pd.concat(list(rows)).sort_values(["frame_idx", "end_of_signal"], kind="stable").itertuples():
            out += [(key[0], *x) for x in rule.feed(int(r.frame_idx), list(r.array), bool(r.end_of_signal))]
        if c.following == 0:
            self.chunks.clear()
            self.glued.clear()
        else:
            self.chunks.update((c.buffer, -1 if c.at is None else c.at, c.last, c.following))
            self.glued.update((g.letters, g.times))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def transcribe_stream(messages: DataFrame, load: Callable[[], Model], rate: int, size: int, step: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """Streaming messages (message_id, frame_idx, array, end_of_signal) to the suffixes of their transcripts; each worker loads the model once a task."""
    return messages.groupBy("message_id").transformWithStateInPandas(TranscribeProcessor(load, rate, (size, step, least, most)), OUT, "Append", "None")


def transcribe_batch(messages: DataFrame, load: Callable[[], Model], rate: int, size: int, step: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """The same rule over a batch table: sorted messages pass through a task as a stream, of which one chunk and the last letters are held."""
    rows = messages.select("message_id", "frame_idx", "array", "end_of_signal").repartition("message_id").sortWithinPartitions("message_id", "frame_idx", "end_of_signal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, current, rule = load(), None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if rule is None or r["message_id"] != current:
                    current, rule = r["message_id"], Transcriber(model, Chunker(size, step, least, most), Gluer(), rate)
                out += [dict(zip(COLUMNS, (current, *x), strict=True)) for x in rule.feed(r["frame_idx"], r["array"], r["end_of_signal"])]
            schema = pa.schema([("message_id", pa.string()), ("frame_idx", pa.int64()), ("letters", pa.string()), ("times", pa.list_(pa.float64())), ("end_of_message", pa.bool_())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, OUT)
