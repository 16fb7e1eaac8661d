"""Packing speech into blocks, cutting windows, and putting block results back on the file's clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_MS = 28_000


def pack_blocks(speech: DataFrame, files: DataFrame, max_ms: int = BLOCK_MS, key: str = "conv_id") -> DataFrame:
    """Greedy blocks of speech (key, start_ms, end_ms) for files (key, total_ms): (key, block, start_ms, end_ms).

    A block takes the next segment as long as it then spans ``max_ms`` at most; a block of one longer segment is
    cut at multiples of that. A file without speech is one block (0, total). The fold depends on what it has
    packed, so a file's segments, of which there are few, are folded as one array.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))))
    one = "struct<a:bigint,b:bigint>"
    seed = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("now"))

    def step(s, x):
        grown = F.struct(s["now"]["a"].alias("a"), x["b"].alias("b"))
        return F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), x.alias("now"))).when(
            x["b"] - s["now"]["a"] <= max_ms, F.struct(s["done"].alias("done"), grown.alias("now"))
        ).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now")))

    folded = F.aggregate(listed.cast(f"array<{one}>"), seed, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    blocks = speech.groupBy(key).agg(folded.alias("blocks"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("total_ms").cast("long").alias("b")))
    rows = files.select(key, "total_ms").join(blocks, key, "left").select(key, F.explode(F.coalesce("blocks", whole)).alias("x"))
    starts = F.when(F.col("x.b") > F.col("x.a"), F.sequence(F.col("x.a"), F.col("x.b") - 1, F.lit(max_ms).cast("long"))).otherwise(F.array("x.a"))
    cut = rows.select(key, F.explode(starts).alias("start_ms"), F.col("x.b").alias("b"))
    cut = cut.select(key, "start_ms", F.least(F.col("start_ms") + max_ms, "b").alias("end_ms"))
    from .islands import number

    return number(cut, key, ["start_ms", "end_ms"], 0, "block").select(key, "block", "start_ms", "end_ms")


def sliding_windows(files: DataFrame, width: int, stride: int, length: str, key: str) -> DataFrame:
    """Windows of a length: (key, window, first, real), as long as they begin within it; ``real`` is what isn't padding."""
    starts = F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1, F.lit(stride).cast("long")))
    return files.select(key, F.posexplode(starts).alias("window", "first"), length).select(
        key, F.col("window").cast("long").alias("window"), "first", F.least(F.lit(width).cast("long"), F.col(length) - F.col("first")).alias("real")
    )


def tumbling(samples: DataFrame, width: int, value: str, key: str = "file", at: str = "i") -> DataFrame:
    """Fixed frames of ``width`` samples, the last one padded with zeros: (key, frame, n, total)."""
    return samples.groupBy(key, F.floor(F.col(at) / width).alias("frame")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def block_slice(samples, rate: int, start_ms, end_ms):
    """The part of a sample array that a block covers."""
    first = F.floor(F.greatest(start_ms, F.lit(0)) * rate / 1000)
    last = F.least(F.floor(F.greatest(end_ms, F.lit(0)) * rate / 1000), F.size(samples))
    return F.slice(samples, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def concat_blocks(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Block results (key, block, seg, block_start_ms, start_ms, end_ms, text, language, device) to one row for each file:
    (key, n_segments, first_ms, last_ms, text, language, device).

    Blank segments are dropped and times move to the file's clock; the language is the first block's, the device the last one's.
    """
    from ..functions.text import strip

    kept = segments.where(strip(F.col("text")) != "").withColumn("start_ms", F.col("start_ms") + F.col("block_start_ms")).withColumn("end_ms", F.col("end_ms") + F.col("block_start_ms"))
    heads = segments.groupBy(key).agg(F.min(F.struct("block", "seg", "language"))["language"].alias("language"), F.max(F.struct("block", "seg", "device"))["device"].alias("device"))
    listed = F.array_sort(F.collect_list(F.struct("block", "seg", strip(F.col("text")).alias("t"))))
    body = kept.groupBy(key).agg(
        F.count("*").alias("n_segments"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("text")
    )
    return heads.join(body, key, "left").select(key, F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), "first_ms", "last_ms", F.coalesce("text", F.lit("")).alias("text"), "language", "device")
