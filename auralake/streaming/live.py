"""Live forms of the stateful operators: voice activity over arriving frames, with state by file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

OUT = "file long, first long, last long, closed boolean"


class VoiceActivity:
    """The hysteresis of ``islands.voice_activity``, frame by frame: ``push`` returns a closed segment or None."""

    def __init__(self, on: float = 0.5, off: float = 0.35, min_silence: int = 4, min_speech: int = 8, state: tuple | None = None):
        self.on, self.off, self.min_silence, self.min_speech = on, off, min_silence, min_speech
        self.first, self.silence = state or (-1, -1)

    def push(self, i: int, p: float) -> tuple[int, int] | None:
        if p >= self.on:
            self.silence = -1
            self.first = i if self.first < 0 else self.first
        elif p < self.off and self.first >= 0:
            self.silence = i if self.silence < 0 else self.silence
            if i - self.silence >= self.min_silence:
                found = (self.first, self.silence)
                self.first = self.silence = -1
                return found if found[1] - found[0] >= self.min_speech else None
        return None

    def end(self, n: int) -> tuple[int, int] | None:
        """The segment that the stream's end closes."""
        if self.first < 0:
            return None
        last = self.silence if self.silence >= 0 else n
        return (self.first, last) if last - self.first >= self.min_speech else None


class _Processor(StatefulProcessor):
    def __init__(self, levels: tuple[float, float, int, int]):
        self.levels = levels

    def init(self, handle) -> None:
        self.state = handle.getValueState("vad", "first long, silence long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        vad = VoiceActivity(*self.levels, state=tuple(self.state.get()) if self.state.exists() else None)
        frames, found = pd.concat(list(rows)).sort_values("i"), []
        for i, p in zip(frames.i, frames.p, strict=True):
            if pd.isna(p):
                found.append((vad.end(int(i)), False))
                vad.first = vad.silence = -1
            else:
                found.append((vad.push(int(i), float(p)), True))
        self.state.update((vad.first, vad.silence))
        if found := [(key[0], *s, closed) for s, closed in found if s]:
            yield pd.DataFrame(found, columns=["file", "first", "last", "closed"])

    def close(self) -> None:
        pass


def voice_activity_stream(frames: DataFrame, on: float = 0.5, off: float = 0.35, min_silence: int = 4, min_speech: int = 8) -> DataFrame:
    """Speech segments of a stream of frames (file, i, p), each as soon as it closes.

    A file's frames arrive in order: frames of one batch are sorted, but a frame that comes in a later batch than its successors is
    taken at its arrival. A row with a null p ends the file before frame i and brings out the segment that is still open, as not
    closed; without such a row that segment stays in the state. The session needs the RocksDB state store.
    """
    return frames.groupBy("file").transformWithStateInPandas(
        _Processor((on, off, min_silence, min_speech)), outputStructType=OUT, outputMode="append", timeMode="none"
    )
