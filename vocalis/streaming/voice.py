"""Voice segments of sample streams: pieces are re-buffered to frames, a model scores each frame, a rule makes segments of the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "message_id string, segment long, start long, end long, final boolean"
COLUMNS = ["message_id", "segment", "start", "end", "final"]
STATE = "rest array<double>, context array<double>, at long, left long, start long, kept long, segment long"
#: From the samples of a window that ends with the frame to the score of voice.
Scorer = Callable[[np.ndarray], float]


class Frames:
    """Samples in frames of ``size``. A piece may not be longer than a frame, so it gives at most one; what is left comes with the end."""

    def __init__(self, size: int):
        self.size, self.rest = size, np.zeros(0)

    def feed(self, piece: np.ndarray) -> np.ndarray | None:
        if len(piece) > self.size:
            raise ValueError(f"a piece of {len(piece)} samples is longer than a frame of {self.size}")
        samples = np.concatenate([self.rest, piece])
        if len(samples) < self.size:
            self.rest = samples
            return None
        self.rest = samples[self.size :]
        return samples[: self.size]

    def flush(self) -> np.ndarray | None:
        frame, self.rest = self.rest, np.zeros(0)
        return frame if len(frame) else None


class VoiceRule:
    """Spans of samples for frames that are voiced or not.

    A segment goes on over up to ``patience`` unvoiced frames in a row, and a signal begins with that patience. The frame after them closes it: the last
    half of the patience is cut off, and as many frames before the segment, that belong to no other, are put in front. The end of the signal cuts nothing off.
    """

    def __init__(self, size: int, patience: int = 2):
        self.size, self.patience, self.memory = size, patience, patience // 2
        self.left, self.start, self.kept = patience, -1, 0

    def feed(self, at: int, n: int, voiced: bool) -> tuple[int, int, bool] | None:
        out = None
        if voiced or self.left > 0:
            self.start = at if self.start < 0 else self.start
            out = (self.start, at + n, False)
        elif self.start >= 0:
            out = (self.start - self.kept, at - self.memory * self.size, True)
            self.start, self.kept = -1, min(1, self.memory) * self.size
        else:
            self.kept = min(self.kept + self.size, self.memory * self.size)
        self.left = self.patience if voiced else self.left - 1
        return out

    def finish(self, at: int) -> tuple[int, int, bool] | None:
        out = (self.start - self.kept, at, True) if self.start >= 0 else None
        self.left, self.start, self.kept = self.patience, -1, 0
        return out


class Segmenter:
    """The rule for one message: ``(segment, start, end, final)`` in samples; a segment that goes on is told only if ``ongoing``."""

    def __init__(self, score: Scorer, size: int, window: int, threshold: float, patience: int, ongoing: bool):
        self.score, self.threshold, self.ongoing = score, threshold, ongoing
        self.frames, self.rule = Frames(size), VoiceRule(size, patience)
        self.context, self.at, self.segment = np.zeros(size * (window - 1)), 0, 0

    def _frame(self, frame: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
        if frame is None:
            return []
        samples = np.concatenate([self.context, frame])
        found = self.rule.feed(self.at, len(frame), self.score(samples) >= self.threshold)
        self.context, self.at = samples[len(samples) - len(self.context) :], self.at + len(frame)
        return self._told(found)

    def _told(self, found: tuple[int, int, bool] | None) -> list[tuple[int, int, int, bool]]:
        if found is None or not (found[2] or self.ongoing):
            return []
        told = [(self.segment, *found)]
        self.segment += found[2]
        return told

    def feed(self, piece: list[float] | None, end: bool) -> list[tuple[int, int, int, bool]]:
        out = self._frame(self.frames.feed(np.asarray([] if piece is None else piece, float)))
        if end:
            out += self._frame(self.frames.flush())
            out += self._told(self.rule.finish(self.at))
            self.context, self.at, self.segment = np.zeros(len(self.context)), 0, 0
        return out

    def state(self) -> tuple:
        return (self.frames.rest.tolist(), self.context.tolist(), self.at, self.rule.left, self.rule.start, self.rule.kept, self.segment)

    def restore(self, state: tuple) -> None:
        rest, context, self.at, self.rule.left, self.rule.start, self.rule.kept, self.segment = state
        self.frames.rest, self.context = np.asarray(rest, float), np.asarray(context, float)


class VoiceProcessor(StatefulProcessor):
    def __init__(self, load: Callable[[], Scorer], rule: tuple):
        self.load, self.rule = load, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = self.load()
        self.kept = handle.getValueState("voice", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = Segmenter(self.score, *self.rule)
        if self.kept.exists():
            s.restore(self.kept.get())
        out = []
        for r in pd.concat(list(rows)).sort_values(["frame_idx", "end_of_signal"], kind="stable").itertuples():
            out += [(key[0], *x) for x in s.feed(r.array, bool(r.end_of_signal))]
        if s.at or len(s.frames.rest):
            self.kept.update(s.state())
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def voice_stream(messages: DataFrame, load: Callable[[], Scorer], size: int, window: int = 1, threshold: float = 0.5, patience: int = 2, ongoing: bool = False) -> DataFrame:
    """Streaming messages (message_id, frame_idx, array, end_of_signal) to voice segments in samples.

    A frame has ``size`` samples; the model, loaded once a task, sees ``window`` frames up to it (zeros before the signal). The state of a message is a
    window and some numbers, whatever a segment's length; null pieces are empty, and a message's state goes with its end.
    """
    return messages.groupBy("message_id").transformWithStateInPandas(VoiceProcessor(load, (size, window, threshold, patience, ongoing)), OUT, "Append", "None")


def voice_batch(messages: DataFrame, load: Callable[[], Scorer], size: int, window: int = 1, threshold: float = 0.5, patience: int = 2, ongoing: bool = False) -> DataFrame:
    """The same rule over a batch table: sorted messages pass through a task as a stream. A message without an end keeps its open segment to itself."""
    rows = messages.select("message_id", "frame_idx", "array", "end_of_signal").repartition("message_id").sortWithinPartitions("message_id", "frame_idx", "end_of_signal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, current, rule = load(), None, None
        schema = pa.schema([("message_id", pa.string()), ("segment", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("final", pa.bool_())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if rule is None or r["message_id"] != current:
                    current, rule = r["message_id"], Segmenter(score, size, window, threshold, patience, ongoing)
                out += [dict(zip(COLUMNS, (current, *x), strict=True)) for x in rule.feed(r["array"], bool(r["end_of_signal"]))]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, OUT)
