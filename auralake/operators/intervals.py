"""Interval joins: who speaks a word, and which segments have several speakers.

Every join has the file (conversation) as an equi key and, beside it, a time bucket: both sides go to the buckets
that they touch, so that a long file is many keys and no pair of far intervals is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 30_000


def _bucketed(rows: DataFrame, lo, hi, bucket_ms: int) -> DataFrame:
    return rows.withColumn("_b", F.explode(F.sequence(F.floor(lo / bucket_ms), F.floor(hi / bucket_ms))))


def best_speaker(words: DataFrame, turns: DataFrame, key: str = "conv_id", at: str = "pos", tolerance_ms: int = 500, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """words (key, at, start_ms, end_ms, ...) with the speaker of the turn that overlaps each the longest.

    Without an overlap, that of the turn nearest to the word's middle, if within the tolerance; else null. Of equal
    turns the first in the list (idx) counts. Distances are in half milliseconds, so that middles are whole.
    """
    w2, t2 = F.col("start_ms") + F.col("end_ms"), tolerance_ms * 2
    left = _bucketed(words.select(key, at, "start_ms", "end_ms"), F.col("start_ms"), F.col("end_ms"), bucket_ms)
    right = _bucketed(turns.select(key, "idx", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker"), F.col("t0") - tolerance_ms, F.col("t1") + tolerance_ms, bucket_ms)
    shared = F.least("end_ms", "t1") - F.greatest("start_ms", "t0")
    far = F.greatest(2 * F.col("t0") - w2, w2 - 2 * F.col("t1"), F.lit(0))
    pairs = left.join(right, [key, "_b"]).withColumn("_o", F.greatest(shared, F.lit(0))).withColumn("_d", F.when(F.col("_o") > 0, 0).otherwise(far)).where((F.col("_o") > 0) | (F.col("_d") <= t2))
    best = pairs.groupBy(key, at).agg(F.min(F.struct((-F.col("_o")).alias("o"), F.col("_d").alias("d"), "idx", "speaker"))["speaker"].alias("speaker"))
    return words.join(best, [key, at], "left")


def vote(words: DataFrame, keys: list[str]) -> DataFrame:
    """The speaker of most words of each group, the least one of a tie; null if no word has a speaker: (*keys, speaker, votes)."""
    counted = words.groupBy(*keys, "speaker").agg(F.count("speaker").alias("n"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("speaker")).alias("s"))))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.s")).alias("speaker"), F.coalesce("b.n", F.lit(0)).cast("long").alias("votes"))


def mark_overlaps(segments: DataFrame, regions: DataFrame, turns: DataFrame, key: str = "conv_id", seg: str = "id", min_ms: int = 100, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Segments (key, seg, start_ms, end_ms, speaker) with ``speakers`` and ``overlap``.

    A segment qualifies if a single region covers 100 ms and a tenth of it; its speakers are those of the turns
    within it, longest first (least first of a tie), and at least two. The segment's own speaker, if among
    them, changes places with the first.
    """
    ends = segments.select(key, seg, "start_ms", "end_ms")
    left = _bucketed(ends, F.col("start_ms"), F.greatest("end_ms", "start_ms"), bucket_ms)
    cut = lambda rows: _bucketed(rows, F.col("t0"), F.greatest("t1", "t0"), bucket_ms)
    shared = F.least("end_ms", "t1") - F.greatest("start_ms", "t0")
    hit = left.join(cut(regions.select(key, F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"))), [key, "_b"]).withColumn("_o", shared).where("_o > 0")
    hit = hit.groupBy(key, seg).agg(F.max("_o").alias("_o"), F.first("start_ms").alias("s"), F.first("end_ms").alias("e"))
    hit = hit.where(10 * F.col("_o") >= F.greatest(F.lit(10 * min_ms), F.col("e") - F.col("s"))).select(key, seg)
    who = left.join(cut(turns.select(key, "idx", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), F.col("speaker").alias("who"))), [key, "_b"]).withColumn("_o", shared).where("_o > 0")
    who = who.dropDuplicates([key, seg, "idx"]).groupBy(key, seg, "who").agg(F.sum("_o").alias("_o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_o")).alias("o"), F.col("who").alias("w")))), lambda x: x["w"])
    who = who.groupBy(key, seg).agg(listed.alias("found")).where("size(found) >= 2").join(hit, [key, seg])
    out = segments.join(who, [key, seg], "left")
    at = F.coalesce(F.array_position("found", F.col("speaker")), F.lit(0))
    swapped = F.transform("found", lambda x, i: F.when(i == 0, F.col("speaker")).when(i == at - 1, F.element_at("found", 1)).otherwise(x))
    speakers = F.when(F.col("found").isNull(), F.array().cast("array<bigint>")).when(at > 1, swapped).otherwise(F.col("found"))
    return out.withColumn("speakers", speakers).withColumn("overlap", F.col("found").isNotNull()).drop("found")


def rank_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
