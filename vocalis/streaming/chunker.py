"""Overlapping chunks of message streams, with state for each message."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "message_id string, frame_idx long, array array<double>, end_of_signal boolean"
STATE = "buffer array<double>, at long, last long, following long"


@dataclass
class Chunker:
    """The rule for one message. Feed pieces in order; each gives the chunks that are ready.

    ``size`` is a chunk, ``step`` the least advance, ``least`` the first early chunk (None for no early
    chunks), ``most`` the largest advance (None for always ``step``).
    """

    size: int
    step: int
    least: int | None = None
    most: int | None = None
    buffer: list[float] = field(default_factory=list)
    at: int | None = None
    last: int = 0
    following: int = 0

    def feed(self, frame_idx: int, piece: list[float], end: bool) -> list[tuple[int, list[float], bool]]:
        if frame_idx != self.following:
            raise ValueError(f"a gap in the message: sample {self.following} was due, {frame_idx} came")
        self.following += len(piece)
        self.buffer += piece
        out: list[tuple[int, list[float], bool]] = []
        if len(self.buffer) >= self.size + (0 if self.at is None else self.step):
            while len(self.buffer) >= self.size + (0 if self.at is None else self.step):
                go = 0 if self.at is None else self.step if self.most is None else min(self.most, len(self.buffer) - self.size)
                self.at = (self.at or 0) + go
                self.buffer = self.buffer[go:]
                out.append((self.at, self.buffer[: self.size], end and len(self.buffer) == self.size))
            if end and not out[-1][2]:
                out.append(self._rest())
        elif self.least is not None and self.at is None and len(self.buffer) >= self.least and len(self.buffer) >= self.last + self.step:
            self.last = len(self.buffer)
            out.append((0, list(self.buffer), end))
        elif end:
            out.append(self._rest())
        if end:
            self.buffer, self.at, self.last, self.following = [], None, 0, 0
        return out

    def _rest(self) -> tuple[int, list[float], bool]:
        n = min(self.size, len(self.buffer))
        return (self.at or 0) + len(self.buffer) - n, self.buffer[len(self.buffer) - n :], True


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["frame_idx", "end_of_signal"], kind="stable")


class ChunkProcessor(StatefulProcessor):
    def __init__(self, size: int, step: int, least: int | None = None, most: int | None = None):
        self.rule = (size, step, least, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunk", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = Chunker(*self.rule)
        if self.state.exists():
            buffer, at, last, following = self.state.get()
            c.buffer, c.at, c.last, c.following = list(buffer), None if at < 0 else at, last, following
        out = []
        for r in _in_order(rows).itertuples():
            out += [(key[0], i, x, e) for i, x, e in c.feed(int(r.frame_idx), list(r.array), bool(r.end_of_signal))]
        if c.following == 0:
            self.state.clear()
        else:
            self.state.update((c.buffer, -1 if c.at is None else c.at, c.last, c.following))
        yield pd.DataFrame(out, columns=["message_id", "frame_idx", "array", "end_of_signal"])

    def close(self) -> None:
        pass


def chunk_stream(messages: DataFrame, size: int, step: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """Streaming messages (message_id, frame_idx, array, end_of_signal) to overlapping chunks."""
    return messages.groupBy("message_id").transformWithStateInPandas(ChunkProcessor(size, step, least, most), OUT, "Append", "None")


def chunk_batch(messages: DataFrame, size: int, step: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """The same rule over a batch table; a message is one task's work."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunker(size, step, least, most)
        out = [(key[0], i, x, e) for r in _in_order(iter([pdf])).itertuples() for i, x, e in c.feed(int(r.frame_idx), list(r.array), bool(r.end_of_signal))]
        return pd.DataFrame(out, columns=["message_id", "frame_idx", "array", "end_of_signal"])

    return messages.groupBy("message_id").applyInPandas(run, OUT)
