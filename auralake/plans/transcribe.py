"""From media files to written transcripts: one plan for all files, of the operators for each step.

A file of 28 s or less is scored in one pass; a longer one is cut where nobody speaks. Whatever fails is the
error of its file, and the others go on.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, strip
from ..operators import batch, engines, intervals, islands, packing, render
from ..operators.signal import RATE
from ..sources.audio import decode_rows

#: Samples of one voice frame, at 16 kHz.
FRAME = 512
WORDS = "array<struct<text:string,start:double,end:double,confidence:double>>"


@dataclass(frozen=True)
class Options:
    """What a run is asked for. ``voice`` gives the chance of speech of each frame of 512 samples (the last one padded with zeros);
    without it no file is cut. ``turns`` gives (start, end, speaker) in seconds for a file's samples; without it nobody is named."""

    model: str = "stub"
    fmt: str = "md"
    folder: str | None = None
    force: bool = False
    timestamps: bool = False
    language: str | None = None
    init_prompt: str | None = None
    voice: Callable[[np.ndarray], np.ndarray] | None = None
    turns: Callable[[np.ndarray, int], list[tuple[float, float, int]]] | None = None
    regions: Callable[[np.ndarray, int], list[tuple[float, float]]] | None = None
    engine: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.fmt not in EXTENSIONS:
            raise ValueError(f"unknown format {self.fmt!r}; known: {', '.join(EXTENSIONS)}")
        if self.regions and not self.turns:
            raise ValueError("regions of several speakers need turns")
        if self.timestamps and self.fmt != "md":
            raise ValueError("timestamps are an option of md; srt and vtt always have them")


def energy_voice(x: np.ndarray) -> np.ndarray:
    """A stand-in for a voice model: 1 for frames that aren't silent."""
    return (np.abs(x).max(axis=1) > 0.01).astype(float)


def _each(audio: DataFrame, call: Callable, schema: str) -> DataFrame:
    """call(samples, rate) -> rows of a file, each behind the path."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, x, rate in zip(frame.path, frame.samples, frame.sample_rate, strict=True):
                yield pd.DataFrame([(path, *row) for row in call(np.asarray(x, np.float32), int(rate))], columns=columns)

    return audio.select("path", "samples", "sample_rate").mapInPandas(run, schema)


def speech(audio: DataFrame, voice: Callable, **levels) -> DataFrame:
    """The speech of files (path, samples, sample_rate): (path, start_ms, end_ms)."""

    def frames(x, rate):
        x = np.append(x, np.zeros(-len(x) % FRAME, np.float32)).reshape(-1, FRAME)
        return [(i, float(p)) for i, p in enumerate(voice(x))]

    found = islands.voice_activity(_each(audio, frames, "file string, i long, p double"), **levels)
    return found.select(F.col("file").alias("path"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def blocks(audio: DataFrame, voice: Callable | None) -> DataFrame:
    """What is scored at a time: (path, block, start_ms, samples, sample_rate). Blocks without a sample are left out."""
    files = audio.withColumn("total_ms", F.floor(F.size("samples") * 1000 / F.col("sample_rate")).cast("long"))
    short = F.lit(True) if voice is None else F.size("samples") <= F.lit(packing.BLOCK_MS) * F.col("sample_rate") / 1000
    once = files.where(short).select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("start_ms"), "samples", "sample_rate")
    if voice is None:
        return once
    long = files.where(~short)
    cut = packing.pack_blocks(speech(long, voice), long, key="path").join(long.select("path", "samples", "sample_rate"), "path")
    part = packing.block_slice(F.col("samples"), F.col("sample_rate"), F.col("start_ms"), F.col("end_ms"))
    return once.unionByName(cut.select("path", "block", "start_ms", part.alias("samples"), "sample_rate").where(F.size("samples") > 0))


def _ms(seconds) -> F.Column:
    return F.round(seconds * 1000).cast("long")


def named(segments: DataFrame, turns: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Segments (path, id, start_s, end_s, text, words) of files with turns (path, idx, start_ms, end_ms, speaker), a run of one
    speaker each; a file without words keeps its segments, each with the speaker of its own time; a file without turns stays as it is."""
    own = segments.withColumn("start_ms", _ms(F.col("start_s"))).withColumn("end_ms", _ms(F.col("end_s")))
    spoken = turns.select("path").distinct()
    worded = own.where(F.size("words") > 0).select("path").distinct()
    words = own.join(spoken, "path", "left_semi").select("path", "id", F.posexplode("words").alias("k", "x"))
    words = islands.number(words, "path", ["id", "k"], 0, "pos").select(
        "path", "pos", F.col("x.text").alias("w"), _ms(F.col("x.start")).alias("start_ms"), _ms(F.col("x.end")).alias("end_ms"), "x"
    )
    told = intervals.best_speaker(words, turns, key="path")
    runs = islands.segment_by_speaker(told, key="path").select("path", "id", "start_ms", "end_ms", "speaker", "text")
    silent = own.join(spoken, "path", "left_semi").join(worded, "path", "left_anti")
    silent = intervals.best_speaker(silent.select("path", F.col("id").alias("pos"), "start_ms", "end_ms", "text"), turns, key="path")
    silent = silent.select("path", F.col("pos").alias("id"), "start_ms", "end_ms", "speaker", "text")
    rest = own.join(spoken, "path", "left_anti").select("path", "id", "start_ms", "end_ms", F.lit(None).cast("long").alias("speaker"), "text")
    found = runs.unionByName(silent).unionByName(rest)
    if regions is None:
        return found.withColumn("speakers", F.array().cast("array<bigint>")).withColumn("overlap", F.lit(False))
    return intervals.mark_overlaps(found, regions, turns, key="path")


def transcripts(audio: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, headers (one for each file) and errors (path, error) of decoded files; see ``render``."""
    scored = engines.transcribe_blocks(blocks(audio, options.voice), options.model, "path", options.language, options.init_prompt, **options.engine)
    segments = engines.rebased(scored)
    first = F.min(F.when(F.col("error").isNull(), F.struct("block", "language")))["language"]
    last = F.max(F.when(F.col("error").isNull(), F.struct("block", "device")))["device"]
    heads = scored.groupBy("path").agg(first.alias("language"), last.alias("device"), F.min("error").alias("error"))
    listed = F.array_sort(F.collect_list(F.struct("id", strip(F.col("text")).alias("t"))))
    text = segments.groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("text"))
    if options.turns:
        find, regions = options.turns, None
        turns = _each(audio, lambda x, rate: [(i, round(a * 1000), round(b * 1000), s) for i, (a, b, s) in enumerate(find(x, rate))], "path string, idx long, start_ms long, end_ms long, speaker long")
        if options.regions:
            several = options.regions
            regions = _each(audio, lambda x, rate: [(round(a * 1000), round(b * 1000)) for a, b in several(x, rate)], "path string, start_ms long, end_ms long")
        segments = named(segments, turns, regions)
        label = lambda x: F.concat(F.lit("Hablante "), (x + 1).cast("string"))
        segments = segments.select("path", "id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text", label(F.col("speaker")).alias("speaker"), F.transform("speakers", label).alias("speakers"), "overlap")
    else:
        segments = segments.withColumn("speaker", F.lit(None).cast("string")).withColumn("speakers", F.array().cast("array<string>")).withColumn("overlap", F.lit(False))
    headers = audio.select("path", F.col("path").alias("file"), "duration_s").join(heads, "path", "left").join(text, "path", "left").select(
        "path", "file", "duration_s", F.coalesce("language", F.lit(options.language or "")).alias("language"),
        F.lit(options.model).alias("model"), F.coalesce("device", F.lit("")).alias("device"), F.coalesce("text", F.lit("")).alias("text"), "error",
    )
    return segments, headers.drop("error"), headers.select("path", "error").where("error is not null")


def write_files(rows: DataFrame, force: bool = False) -> DataFrame:
    """Writes each body of rows (path, out_path, collides, body, error) to its out_path: (path, out_path, error).

    Files are there whole or not at all. One that is there already is an error, unless forced or equal, as it is when a task is repeated;
    so is every input but the first whose output has the same name. The folder must be one that all executors share.
    """

    def put(path: str, body: str) -> str | None:
        data = body.encode()
        if os.path.exists(path) and not force:
            with open(path, "rb") as f:
                return None if f.read() == data else f"exists: {path}"
        temporary = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
        return None

    def run(frames):
        for frame in frames:
            errors = []
            for out, twice, body, error in zip(frame.out_path, frame.collides, frame.body, frame.error, strict=True):
                if error is None and twice:
                    error = f"exists: {out}"
                try:
                    errors.append(error if error is not None else put(out.removeprefix("file:"), body))
                except OSError as e:
                    errors.append(f"writing {out}: {e}")
            yield frame.assign(error=errors)[["path", "out_path", "error"]]

    return rows.select("path", "out_path", "collides", "body", "error").mapInPandas(run, "path string, out_path string, error string")


def process(spark: SparkSession, inputs: DataFrame, options: Options) -> DataFrame:
    """Media files (path, content) to written transcripts: (path, out_path, error), ordered by path; ``batch.summary`` counts them."""
    decoded = decode_rows(inputs.select("path", "content"), RATE)
    audio = decoded.where("error is null").select("path", "sample_rate", "duration_s", "samples")
    segments, headers, failed = transcripts(audio, options)
    bodies = render.render(segments, headers, "path", options.fmt, options.timestamps)
    errors = decoded.where("error is not null").select("path", F.concat(F.lit("decoding: "), "error").alias("error"))
    errors = errors.unionByName(failed.select("path", F.concat(F.lit("transcribing: "), "error").alias("error")))
    named_out = batch.outputs(inputs.select("path"), options.fmt, options.folder)
    # A file without any segment has no cue, but its output.
    rows = named_out.join(bodies, "path", "left").join(errors, "path", "left").withColumn("body", F.coalesce("body", F.lit("WEBVTT\n\n" if options.fmt == "vtt" else "")))
    return write_files(rows, options.force).orderBy("path")
