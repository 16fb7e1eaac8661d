"""Batches of files: inputs, the model catalogue, planning, results and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_media, output_path

#: GB of a worker by model, and the share of the memory that workers may have.
WORKER_GB, MEMORY_SHARE = {"whisper": 1.5, "": 1.0}, 0.7


def gather_inputs(explicit: DataFrame, listed: DataFrame) -> DataFrame:
    """Named files as they are, and of listed ones the media; each path once, in order: (path)."""
    return explicit.select("path").unionByName(listed.select("path").where(is_media(F.col("path")))).distinct().orderBy("path")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Media files of a folder, not of those in it: (path, length, modificationTime)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime").where(is_media(F.col("path")))


def catalogue(spark: SparkSession, toml_text: str) -> DataFrame:
    """Models of a TOML catalogue: (id, kind, license, file: array<struct<name,url,archive_url,archive_member,sha256>>)."""
    import tomllib

    names = ("name", "url", "archive_url", "archive_member", "sha256")
    rows = [(m["id"], m.get("kind"), m.get("license"), [tuple(f.get(n) for n in names) for f in m.get("file", [])]) for m in tomllib.loads(toml_text).get("model", [])]
    file = ",".join(f"{n}:string" for n in names)
    return spark.createDataFrame(rows, f"id string, kind string, license string, file array<struct<{file}>>")


def presence(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(id, files, missing, present): a model is present if it has files and none is missing. wanted: (id, name); there: (name)."""
    marked = wanted.join(there.select("name").distinct().withColumn("_t", F.lit(1)), "name", "left")
    by = marked.groupBy("id").agg(F.count("name").alias("files"), F.count_if(F.col("name").isNotNull() & F.col("_t").isNull()).alias("missing"))
    return by.withColumn("present", (F.col("files") > 0) & (F.col("missing") == 0))


def verify(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, ok): all files are there with the digest that the catalogue has, if any. wanted: (id, name, sha256); contents: (name, content)."""
    found = contents.select("name", F.sha2("content", 256).alias("_is"))
    good = F.col("_is").isNotNull() & (F.col("sha256").isNull() | (F.lower("sha256") == F.col("_is")))
    return wanted.join(found, "name", "left").groupBy("id").agg(F.bool_and(good).alias("ok"))


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def jobs(cores: Column, ram_gb: Column, requested: Column, files: Column, model: Column, accelerated: Column) -> Column:
    """Files to work on at a time: one on an accelerator, else as many as cores (or asked for), files and memory allow."""
    base = F.when(requested == 0, cores).otherwise(requested)
    per = F.when(model.contains("whisper"), WORKER_GB["whisper"]).otherwise(WORKER_GB[""])
    by_memory = F.greatest(F.floor(ram_gb * MEMORY_SHARE / per), F.lit(1))
    return F.when(accelerated, F.lit(1)).otherwise(F.least(F.greatest(F.least(base, F.greatest(files, F.lit(1))), F.lit(1)), by_memory)).cast("long")


def outputs(inputs: DataFrame, fmt: str, folder: str | None = None) -> DataFrame:
    """(path, out_path, collides): inputs of one stem and folder share an output, and all but the first collide."""
    from .islands import number

    rows = number(inputs.select("path", output_path(F.col("path"), fmt, folder).alias("out_path")), "out_path", ["path"], 0, "_n")
    return rows.select("path", "out_path", (F.col("_n") > 0).alias("collides"))


def writable(rows: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Results (path, out_path, ...) with the error of those whose output is there already, unless forced."""
    if force:
        return rows.withColumn("error", F.lit(None).cast("string"))
    marked = rows.join(existing.select("out_path").distinct().withColumn("_e", F.lit(True)), "out_path", "left")
    return marked.withColumn("error", F.when(F.col("_e") | F.col("collides"), F.concat(F.lit("exists: "), "out_path"))).drop("_e")


def summary(results: DataFrame) -> DataFrame:
    """(ok, failed) of results (error)."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
