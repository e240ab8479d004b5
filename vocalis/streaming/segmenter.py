"""Voice segments of frame-score streams, and glued transcripts, with state for each message."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vocalis.operators.transcripts import new_suffix

SEGMENTS = "message_id string, start long, end long"
GLUED = "message_id string, frame_idx long, letters string, times array<double>"


@dataclass
class Hysteresis:
    """A segment begins at the first of ``patience`` voiced frames in a row (and ``memory`` frames before), and ends after as many unvoiced ones."""

    threshold: float = 0.5
    patience: int = 2
    memory: int = 1
    start: int = -1
    run: int = 0

    def feed(self, frame: int, score: float) -> tuple[int, int] | None:
        voiced = score >= self.threshold
        inside = self.start >= 0
        self.run = self.run + 1 if voiced != inside else 0
        if self.run < self.patience:
            return None
        self.run = 0
        if not inside:
            self.start = max(0, frame - self.patience + 1 - self.memory)
            return None
        done = (self.start, frame - self.patience + 1)
        self.start = -1
        return done

    def finish(self, frame: int) -> tuple[int, int] | None:
        done = (self.start, frame + 1) if self.start >= 0 else None
        self.start, self.run = -1, 0
        return done


class SegmentProcessor(StatefulProcessor):
    def __init__(self, threshold: float, patience: int, memory: int):
        self.rule = (threshold, patience, memory)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("voice", "start long, run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        h = Hysteresis(*self.rule)
        if self.state.exists():
            h.start, h.run = self.state.get()
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_idx", kind="stable").itertuples():
            out += [x for x in (h.feed(int(r.frame_idx), float(r.score)), h.finish(int(r.frame_idx)) if r.end_of_signal else None) if x]
        self.state.update((h.start, h.run))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["message_id", "start", "end"])

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, threshold: float = 0.5, patience: int = 2, memory: int = 1) -> DataFrame:
    """Streaming frames (message_id, frame_idx, score, end_of_signal) to voiced segments."""
    return frames.groupBy("message_id").transformWithStateInPandas(SegmentProcessor(threshold, patience, memory), SEGMENTS, "Append", "None")


@dataclass
class Gluer:
    """Keeps the last seconds of what was glued; a part that doesn't match adds nothing."""

    keep: float = 100.0
    letters: str = ""
    times: list[float] = field(default_factory=list)

    def feed(self, letters: str, times: list[float]) -> tuple[str, list[float]] | None:
        found = new_suffix((self.letters, self.times), (letters, times))
        if found is None:
            return None
        new, stamps = found
        if stamps:
            cut = next((i for i, t in enumerate(self.times) if t >= stamps[0]), len(self.times))
            self.letters, self.times = self.letters[:cut] + new, self.times[:cut] + stamps
            first = next((i for i, t in enumerate(self.times) if t >= self.times[-1] - self.keep), 0)
            self.letters, self.times = self.letters[first:], self.times[first:]
        return new, stamps


class GlueProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("glued", "letters string, times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = Gluer()
        if self.state.exists():
            letters, times = self.state.get()
            g.letters, g.times = letters, list(times)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_idx", kind="stable").itertuples():
            found = g.feed(r.letters, list(r.times))
            if found:
                out.append((key[0], int(r.frame_idx), *found))
        self.state.update((g.letters, g.times))
        yield pd.DataFrame(out, columns=["message_id", "frame_idx", "letters", "times"])

    def close(self) -> None:
        pass


def glue_stream(parts: DataFrame) -> DataFrame:
    """Streaming transcripts (message_id, frame_idx, letters, times) to the suffixes that each adds."""
    return parts.groupBy("message_id").transformWithStateInPandas(GlueProcessor(), GLUED, "Append", "None")
