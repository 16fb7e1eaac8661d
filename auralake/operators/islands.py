"""Gaps and islands: hysteresis, runs, merged turns and re-segmentation, all as window expressions over one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def voice_activity(frames: DataFrame, on: float = 0.5, off: float = 0.35, min_silence: int = 4, min_speech: int = 8, frame_ms: int = 32, pad_ms: int = 30) -> DataFrame:
    """Two-threshold speech segments of frames (file, i, p): (file, first, last, closed, start_ms, end_ms).

    A frame at ``on`` or more opens a segment or clears its silence; the first frame below ``off`` after that starts
    the silence, and a later one, ``min_silence`` frames on, closes the segment at the silence's start. An
    open segment ends with its pending silence or the file. Lengths are in frames and tested before the padding,
    which the file's start and, unless the segment was closed, its end cut off.
    """
    by_file = Window.partitionBy("file")
    run = by_file.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    loud, quiet = F.col("p") >= on, F.when(F.col("p") < off, F.col("i"))
    groups = (
        frames.withColumn("g", F.sum(loud.cast("int")).over(run)).withColumn("n", F.count("*").over(by_file)).where("g > 0")
        .groupBy("file", "g").agg(F.max("n").alias("n"), F.min("i").alias("first"), F.min(quiet).alias("q0"), F.max(quiet).alias("q1"))
        .withColumn("closes", F.coalesce(F.col("q1") - F.col("q0") >= min_silence, F.lit(False)))
    )
    before = by_file.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        groups.withColumn("island", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)))
        .groupBy("file", "island").agg(
            F.max("n").alias("n"), F.min("first").alias("first"), F.bool_or("closes").alias("closed"),
            F.max(F.struct("g", "q0"))["q0"].alias("q0"),
        )
        .withColumn("last", F.coalesce("q0", "n")).where(F.col("last") - F.col("first") >= min_speech)
    )
    end = F.col("last") * frame_ms + pad_ms
    return found.select(
        "file", "first", "last", "closed", F.greatest(F.col("first") * frame_ms - pad_ms, F.lit(0)).alias("start_ms"),
        F.when(F.col("closed"), end).otherwise(F.least(end, F.col("n") * frame_ms)).alias("end_ms"),
    )


def runs(rows: DataFrame, state, keys: tuple[str, ...] = ("file",), order: str = "i") -> DataFrame:
    """Maximal runs of rows for which the state holds: (*keys, first, end), end exclusive. The order numbers rows without gaps."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_s", state).withColumn("_r", F.row_number().over(w))
    true_rows = marked.where("_s").withColumn("_t", F.col("_r") - F.row_number().over(w))
    return true_rows.groupBy(*keys, "_t").agg(F.min(order).alias("first"), (F.max(order) + 1).alias("end")).drop("_t")


def boundaries(levels: DataFrame, enter: float = 1.0, leave: float = 0.5, min_frames: int = 10) -> DataFrame:
    """Runs (file, first, end) of levels (file, i, s) between reaching ``enter`` and falling below ``leave``; a value between keeps the state."""
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(F.when(F.col("s") >= enter, True).when(F.col("s") < leave, False), ignorenulls=True).over(w), F.lit(False))
    held = levels.withColumn("_state", state)
    return runs(held, F.col("_state")).where(F.col("end") - F.col("first") >= min_frames)


def overlap_regions(mask: DataFrame, frame_ms: int, min_ms: int = 100) -> DataFrame:
    """Runs of a mask (file, i, m) that last ``min_ms`` or more: (file, start_ms, end_ms)."""
    found = runs(mask, F.col("m")).select("file", (F.col("first") * frame_ms).alias("start_ms"), (F.col("end") * frame_ms).alias("end_ms"))
    return found.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def median_filter(bits: DataFrame, width: int = 11) -> DataFrame:
    """Centred upper median of bits (file, i, b), cut off at the file's ends: (file, i, b, m). Files shorter than the width stay as they are."""
    near = Window.partitionBy("file").orderBy("i").rowsBetween(-(width // 2), width // 2)
    ones, n = F.sum("b").over(near), F.count("*").over(near)
    median = (ones >= n - F.floor(n / 2)).cast("int")
    return bits.withColumn("m", F.when(F.count("*").over(Window.partitionBy("file")) < width, F.col("b")).otherwise(median))


def coalesce_turns(turns: DataFrame, gap_ms: int = 500, key: str = "conv_id") -> DataFrame:
    """Merges turns (key, idx, start_ms, end_ms, speaker) of one speaker that follow each other by less than the gap: (key, idx, start_ms, end_ms, speaker).

    With a gap of 0 or less nothing is merged. The new idx counts the results in their order.
    """
    w = Window.partitionBy(key).orderBy("start_ms", "idx")
    changed = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | F.lag("idx").over(w).isNull()).cast("int")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("_run", F.sum("_c").over(upto)) if "_c" in turns.columns else turns.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(upto))
    inside = Window.partitionBy(key, "_run").orderBy("start_ms", "idx")
    reach = F.max("end_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    split = F.coalesce(F.col("start_ms") - reach >= gap_ms, F.lit(True)) if gap_ms > 0 else F.lit(True)
    rows = rows.withColumn("_n", split.cast("int")).withColumn("_isl", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "_run", "_isl", "speaker").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    place = Window.partitionBy(key).orderBy("_run", "_isl")
    return merged.select(key, (F.row_number().over(place) - 1).cast("long").alias("idx"), "start_ms", "end_ms", "speaker")


def segment_by_speaker(words: DataFrame, key: str = "conv_id") -> DataFrame:
    """Words (key, pos, w, start_ms, end_ms, speaker) to runs of one speaker: (key, id, start_ms, end_ms, speaker, text, n_words).

    Null speakers that follow each other are one run. A segment ends with its last word, not its latest end.
    """
    w = Window.partitionBy(key).orderBy("pos")
    new = (F.lag("pos").over(w).isNull() | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")
    rows = words.withColumn("_new", new).withColumn("id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    listed = F.array_sort(F.collect_list(F.struct("pos", "w", "start_ms", "end_ms")))
    return rows.groupBy(key, "id", "speaker").agg(listed.alias("_w")).select(
        key, "id", F.element_at("_w", 1)["start_ms"].alias("start_ms"), F.element_at("_w", -1)["end_ms"].alias("end_ms"), "speaker",
        F.array_join(F.transform("_w", lambda x: x["w"]), " ").alias("text"), F.size("_w").cast("long").alias("n_words"),
    )


def number(rows: DataFrame, key: str, order: list, start: int = 1, name: str = "n") -> DataFrame:
    """rows with their number within the key."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1 + start).cast("long"))
