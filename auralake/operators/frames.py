"""Frame decisions from window logits: powerset classes, smoothing, and the overlap-add of windows on one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import argmax
from .islands import boundaries, median_filter, overlap_regions

#: The active speakers of each class.
POWERSET = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))


def powerset(logits: DataFrame) -> DataFrame:
    """logits (file, frame, x: array of 7) to (file, frame, cls, s0, s1, s2); without a finite number the class is 0."""
    table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in POWERSET])
    rows = logits.withColumn("cls", F.coalesce(argmax(F.col("x")), F.lit(0)).cast("int"))
    active = F.element_at(table, F.col("cls") + 1)
    return rows.select("file", "frame", "cls", *[F.element_at(active, i + 1).alias(f"s{i}") for i in range(3)])


def smoothed(local: DataFrame, width: int = 11) -> DataFrame:
    """(file, frame, s0, s1, s2) with the median filter over every speaker's frames."""
    out = local.select("file", "frame", "s0", "s1", "s2")
    for s in ("s0", "s1", "s2"):
        m = median_filter(local.select("file", F.col("frame").alias("i"), F.col(s).alias("b")), width)
        out = out.drop(s).join(m.select("file", F.col("i").alias("frame"), F.col("m").alias(s)), ["file", "frame"])
    return out


def overlap_add(windows: DataFrame, frame_ms: float) -> DataFrame:
    """(file, offset_ms, frame, active) to the common grid (file, g, active, weight, mean, speakers, overlap): which
    windows see a frame, how many speakers they count on average, rounded, and whether that is 1.75 or more."""
    place = F.round((F.col("offset_ms") + F.col("frame") * frame_ms) / frame_ms).cast("long")
    grid = windows.groupBy("file", place.alias("g")).agg(F.sum("active").alias("active"), F.count("*").alias("weight"))
    mean = F.col("active") / F.greatest("weight", F.lit(1e-9))
    return grid.withColumn("mean", F.round(mean, 6)).withColumn("speakers", F.floor(mean + 0.5)).withColumn("overlap", mean >= 1.75)


def full_grid(grid: DataFrame, sizes: DataFrame) -> DataFrame:
    """The grid with its empty cells, for files of (file, n_grid) cells."""
    cells = sizes.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_grid") - 1)).alias("g"))
    return cells.join(grid, ["file", "g"], "left").fillna({"active": 0, "weight": 0, "mean": 0.0, "speakers": 0, "overlap": False})


def segment(grid: DataFrame, frame_ms: int, min_frames: int = 10, min_overlap_ms: int = 100) -> tuple[DataFrame, DataFrame]:
    """Speech runs and overlap regions of a full grid."""
    speech = boundaries(grid.select("file", F.col("g").alias("i"), F.col("speakers").cast("double").alias("s")), min_frames=min_frames)
    return speech, overlap_regions(grid.select("file", F.col("g").alias("i"), F.col("overlap").alias("m")), frame_ms, min_overlap_ms)
