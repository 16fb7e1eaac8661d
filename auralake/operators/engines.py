"""Model scoring: the interface that speech models plug into, a registry, a stub without weights, and the decoding loops.

No model weights come with this package. ``StubEngine`` says, for a block of samples, words that are a function of
its energy; it stands for a model in tests. ``OnnxEngine`` runs an exported model where files are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPECIAL

SEGMENTS = "array<struct<start:double,end:double,text:string,words:array<struct<text:string,start:double,end:double,confidence:double>>>>"
#: Ids of a frame at most, and seconds of one encoder frame.
SYMBOLS_PER_FRAME, FRAME_S = 10, 0.08


@dataclass(frozen=True)
class Context:
    init_prompt: str | None = None
    prev_text: str | None = None
    language: str | None = None


@dataclass
class Segment:
    start: float
    end: float
    text: str
    words: list[tuple[str, float, float, float | None]]


@dataclass
class Result:
    segments: list[Segment]
    language: str = "auto"
    device: str = "CPU"


class Engine(Protocol):
    name: str

    def transcribe(self, samples: np.ndarray, rate: int, context: Context = Context()) -> Result: ...


class StubEngine:
    name = "stub"

    def transcribe(self, samples: np.ndarray, rate: int, context: Context = Context()) -> Result:
        check(samples, rate)
        words = [("alto" if np.abs(x).mean() > 0.1 else "bajo", i / 2, min((i + 1) / 2, len(samples) / rate), None) for i, x in enumerate(np.split(samples, range(rate // 2, len(samples), rate // 2)))]
        return Result([Segment(0.0, len(samples) / rate, " ".join(w[0] for w in words), words)], context.language or "es")


def check(samples: np.ndarray, rate: int, expected: int = 16_000) -> None:
    if not len(samples):
        raise ValueError("no samples")
    if rate != expected:
        raise ValueError(f"{rate} Hz; {expected} Hz are needed")


class OnnxEngine:
    """A model folder with ``model.onnx``: samples to logits over a vocabulary, decoded greedily with a blank."""

    name = "onnx"

    def __init__(self, folder: str, vocabulary: dict[int, str], blank: int):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        self.vocabulary, self.blank = vocabulary, blank

    def transcribe(self, samples: np.ndarray, rate: int, context: Context = Context()) -> Result:
        check(samples, rate)
        feeds = {i.name: v for i, v in zip(self.session.get_inputs(), (samples[None].astype(np.float32), np.array([len(samples)], np.int64)), strict=False)}
        logits = self.session.run(None, feeds)[0][0]
        words = words_of(*ctc(logits, self.blank), self.vocabulary, len(samples) / rate)
        return Result([Segment(0.0, len(samples) / rate, " ".join(w[0] for w in words), words)])


ENGINES: dict[str, Callable[..., Engine]] = {"stub": lambda **_: StubEngine(), "onnx": OnnxEngine}


def build_engine(model: str, **options) -> Engine:
    for prefix, make in ENGINES.items():
        if model.startswith(prefix):
            return make(**options)
    raise ValueError(f"unknown model {model!r}; known prefixes: {', '.join(ENGINES)}")


def first_max(x: np.ndarray) -> int | None:
    """The first greatest finite value's place."""
    ok = np.isfinite(x)
    return int(np.argmax(np.where(ok, x, -np.inf))) if ok.any() else None


def ctc(logits: np.ndarray, blank: int) -> tuple[list[int], list[int]]:
    best = [first_max(f) for f in logits]
    keep = [i for i, t in enumerate(best) if t is not None and t != blank and (not i or t != best[i - 1])]
    return [best[i] for i in keep], keep


def duration_decode(step: Callable, frames: int, blank: int, durations: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Greedy decoding of a token-and-duration model: ``step(frame, state) -> (token logits, duration logits, new state)``.

    The state changes with tokens other than the blank. Logits without a finite maximum are an error. A blank moves on by one frame at least, and so does a
    frame that has had ten tokens.
    """
    ids, places, at, here, state = [], [], 0, 0, None
    while at < frames:
        tokens, spans, new = step(at, state)
        token, span = first_max(tokens), first_max(spans)
        if token is None or span is None:
            raise ValueError(f"frame {at}: no finite logit")
        jump = durations[span]
        if token != blank:
            ids.append(token)
            places.append(at)
            state, here = new, here + 1
        if jump == 0 and (token == blank or here >= SYMBOLS_PER_FRAME):
            jump = 1
        at, here = at + jump, here if jump == 0 else 0
    return ids, places


def greedy(step: Callable, prompt: list[int], end: int, longest: int = 448, suppress: frozenset[int] = frozenset(), first: frozenset[int] = frozenset(), above: int | None = None) -> list[int]:
    """Autoregressive decoding: ``step(ids) -> logits``. Suppressed ids, at the first step also ``first``, and ids beyond ``above`` never win."""
    ids, out = list(prompt), []
    while len(ids) < longest:
        x = np.array(step(ids), float)
        x[list(suppress | (first if not out else frozenset()))] = -np.inf
        if above is not None:
            x[above + 1 :] = -np.inf
        t = first_max(x)
        if t is None or t == end:
            break
        ids.append(t)
        out.append(t)
    return out


def words_of(ids: list[int], places: list[int], vocabulary: dict[int, str], duration: float) -> list[tuple[str, float, float, None]]:
    """Words with times: a word begins with a marked piece; it ends a frame after its last one, at the file's end at most."""
    out: list[list] = []
    for i, f in zip(ids, places, strict=False):
        piece = vocabulary.get(i, "")
        if not piece or piece == "▁" or piece in SPECIAL or piece.startswith("<|"):
            continue
        if piece.startswith("▁") or not out:
            out.append([piece.removeprefix("▁"), f, f])
        else:
            out[-1][0] += piece
            out[-1][2] = f
    return [(w, a * FRAME_S, min((b + 1) * FRAME_S, duration), None) for w, a, b in out]


def transcribe_blocks(blocks: DataFrame, model: str, key: str = "path", language: str | None = None, init_prompt: str | None = None, **options) -> DataFrame:
    """Blocks (key, block, start_ms, samples, sample_rate) to (key, block, start_ms, language, device, segments, error).

    A file's blocks are scored in order, each with the text of the block before; an error is kept in its row
    and the file goes on. The engine is made once for each task.
    """
    build_engine(model, **options)  # fail on the driver for an unknown model
    schema = f"{key} {dict(blocks.dtypes)[key]}, block long, start_ms long, language string, device string, segments {SEGMENTS}, error string"
    made: dict[str, Engine] = {}

    def run(pdf):
        import pandas as pd

        engine = made.get(model) or made.setdefault(model, build_engine(model, **options))
        rows, previous = [], None
        for r in pdf.sort_values("block").itertuples():
            try:
                got = engine.transcribe(np.asarray(r.samples, np.float32), int(r.sample_rate), Context(init_prompt, previous, language))
                kept = [s for s in got.segments if s.text.strip()]
                previous = " ".join(s.text.strip() for s in kept)
                segs = [{"start": s.start, "end": s.end, "text": s.text, "words": [dict(zip(("text", "start", "end", "confidence"), w, strict=True)) for w in s.words]} for s in kept]
                rows.append((getattr(r, key), r.block, r.start_ms, got.language, got.device, segs, None))
            except Exception as e:  # one block's failure is its row's
                rows.append((getattr(r, key), r.block, r.start_ms, None, None, [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[key, "block", "start_ms", "language", "device", "segments", "error"])

    return blocks.groupBy(key).applyInPandas(run, schema)


def rebased(results: DataFrame, key: str = "path") -> DataFrame:
    """The segments of all blocks on the file's clock, numbered: (key, id, start_s, end_s, text, words)."""
    from .islands import number

    at = F.col("start_ms") / 1000
    rows = results.select(key, "block", at.alias("_at"), F.posexplode("segments").alias("k", "s"))
    words = F.transform("s.words", lambda w: F.struct(w["text"].alias("text"), (w["start"] + F.col("_at")).alias("start"), (w["end"] + F.col("_at")).alias("end"), w["confidence"].alias("confidence")))
    rows = rows.select(key, "block", "k", (F.col("s.start") + F.col("_at")).alias("start_s"), (F.col("s.end") + F.col("_at")).alias("end_s"), "s.text", words.alias("words"))
    return number(rows, key, ["block", "k"], 0, "id").drop("block", "k")


def map_partitions_with(engine: Callable[[], object], call: Callable, rows: DataFrame, schema: str) -> DataFrame:
    """Scores rows with a model that every task makes once: call(model, frame) -> frame."""

    def run(frames) -> Iterator:
        model = engine()
        for f in frames:
            yield call(model, f)

    return rows.mapInPandas(run, schema)
