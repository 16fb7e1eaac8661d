"""Execution traces and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "array<struct<name:string,dur:string,args:struct<provider:string>>>"
#: Fields of a run's metrics, in their order.
METRICS = ("host", "os", "arch", "device_arg", "ep_primary", "model", "audio_s", "rtf", "t_total_ms", "t_load_ms", "t_model_load_ms", "t_denoise_ms", "t_transcribe_ms", "t_diarize_ms", "t_render_ms", "rss_mb", "n_segments")


def whole_number(json, path: str):
    """The whole number at a JSON path; null if nothing is there or it has another type."""
    return F.get_json_object(json, path).try_cast("bigint")


def read_traces(spark: SparkSession, folder: str, glob: str = "prof_*.json") -> tuple[DataFrame, DataFrame]:
    """Kernel events (file, provider, dur_us) of the trace files of a folder, and the files that are no JSON (file)."""
    texts = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", EVENT).alias("events"))
    bad = texts.where("events is null").select("file")
    events = texts.select("file", F.explode("events").alias("e")).select("file", F.col("e.name").alias("name"), F.col("e.args.provider").alias("provider"), F.col("e.dur").alias("dur"))
    kernel = events.where(F.col("provider").isNotNull() & F.col("name").endswith("_kernel_time"))
    whole = F.when(F.col("dur").rlike(r"^\d+$"), F.col("dur").cast("bigint"))
    return kernel.select("file", "provider", F.coalesce(whole, F.lit(0)).alias("dur_us")), bad


def provider_share(kernels: DataFrame) -> DataFrame:
    """(file, provider, nodes, pct_nodes, ms, pct_time, place): each provider's share of a file's kernels and time, largest time first."""
    by = kernels.groupBy("file", "provider").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("dur_us", F.lit(0))).alias("us"))
    w = Window.partitionBy("file")
    pct = lambda c: F.round(100 * F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)), 6)
    place = F.row_number().over(w.orderBy(F.desc("us"), "provider"))
    return by.select("file", "provider", "nodes", pct("nodes").alias("pct_nodes"), F.round(F.col("us") / 1000, 6).alias("ms"), pct("us").alias("pct_time"), place.cast("long").alias("place"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Totals by host: (host, runs, audio_s, total_s, rtf), from (host, audio_s, total_s)."""
    from ..functions.text import real_time_factor

    agg = runs.groupBy("host").agg(F.count("*").alias("runs"), F.round(F.sum("audio_s"), 4).alias("audio_s"), F.round(F.sum("total_s"), 4).alias("total_s"))
    return agg.withColumn("rtf", F.round(real_time_factor(F.col("total_s"), F.col("audio_s")), 6))


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Appends runs to a folder of JSON lines, all fields in their order."""
    metrics.select(*METRICS).write.mode("append").option("ignoreNullFields", "false").json(folder)
