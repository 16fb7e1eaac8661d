"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map sends slots to shards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

SLOTS = 4096
#: Each slot's rows are numbered in so many parts, so that no task gathers a whole slot.
CELLS = 16


def _hash(c: Column, start: int) -> Column:
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a key: the first 32 bits of its MD5, modulo the number of slots. Null is the empty key."""
    return (_hash(key, 1) % slots).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: slot s lives on shard s mod shards."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version")
    )


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with one shard more: every old shard gives the new one its share, from its last slots.

    Nothing else moves. A shard with n slots gives floor(n / (shards + 1)) of them, so the edit depends
    on the map alone and a key's shard on the key and the number of shards.
    """
    w = Window.partitionBy("shard")
    return (
        slot_map.withColumn("n", F.count("*").over(w))
        .withColumn("r", F.row_number().over(w.orderBy(F.desc("virtual_slot"))))
        .select(
            "virtual_slot",
            F.when(F.col("r") <= F.floor(F.col("n") / (shards + 1)), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
            (F.col("version") + 1).alias("version"),
        )
    )


def rebalance_map(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version for shards of unlike sizes: the heaviest shard's slots beyond its even share go to the lightest.

    ``slot_bytes`` has (virtual_slot, bytes); slots without rows count 0. Over-full shards give up their
    last slots, in slot order, until they are at the mean; the slots given up fill the shards below the
    mean, in order of the running totals. Slots number in the thousands, whatever the rows.
    """
    sized = slot_map.join(slot_bytes, "virtual_slot", "left").fillna(0, ["bytes"])
    every = Window.partitionBy(F.lit(0))
    inside = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("mean", F.sum("bytes").over(every) / shards).withColumn("run", F.sum("bytes").over(inside))
    moved = sized.where(F.col("run") > F.col("mean"))
    totals = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    kept = sized.where(F.col("run") <= F.col("mean")).groupBy("shard").agg(F.sum("bytes").alias("kept"), F.max("mean").alias("mean"))
    mean = sized.agg(F.max("mean").alias("m"))
    room = totals.join(kept, "shard", "left").crossJoin(F.broadcast(mean)).select("shard", (F.col("m") - F.coalesce("kept", F.lit(0))).alias("room"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("hi", F.sum("room").over(up_to)).withColumn("lo", F.col("hi") - F.col("room"))
    queue = Window.partitionBy(F.lit(0)).orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.withColumn("at", F.sum("bytes").over(queue) - F.col("bytes") / 2)
    to = (
        moved.join(F.broadcast(room), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
        .select("virtual_slot", room["shard"].alias("to"))
        .groupBy("virtual_slot").agg(F.min("to").alias("to"))
    )
    return slot_map.join(to, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version")
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot. ``rows`` has (virtual_slot, size)."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Adds a version to the table of maps in a folder and reads it back. A version that is there already is an error."""
    spark = slot_map.sparkSession
    version = slot_map.first().version
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest one unless another is named."""
    maps = spark.read.option("basePath", folder).schema("virtual_slot int, shard int, version int").parquet(folder)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == version)


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Shard and position of every row, by the map's versions for ``shards`` and for one more.

    Returns key, size (UTF-8 bytes plus 1), text_crc32, law ('key'), shard, slot (the row's position in
    its shard, 0, 1, 2 ... without gaps), grown_shard, virtual_slot, slot_bytes (of all rows in that slot), map_version.
    Both versions are stored in a table of the shared folder and read back from it. The law ``key`` leaves bytes out of
    the choice of the shard; ``rebalance_map`` edits a map by them.

    Null texts have no bytes (size 1, checksum 0). A null key is the empty key. Repeated rows and rows with
    equal keys share the shard and get a position each, in the order of (key, size, checksum). An empty
    table gives no rows. Other columns are ignored, whatever their names.

    Positions are cell-wise row numbers plus the number of rows in the shard's earlier cells: a cell holds
    1/65536 of the rows, and the running totals are over the cells, whose number is fixed.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = F.col(key)
    rows = df.select(
        k.alias("_k"),
        (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(body).alias("_crc"),
        virtual_slot(k, slots).alias("_vs"),
        (_hash(k, 9) % CELLS).cast("int").alias("_cell"),
    )
    folder = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    first = store_map(initial_map(spark, shards, slots), folder)
    maps = first.join(store_map(grow_map(first, shards), folder).select("virtual_slot", F.col("shard").alias("grown"), F.col("version").alias("v1")), "virtual_slot")
    cells = rows.groupBy("_vs", "_cell").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    placed = cells.join(maps.withColumnRenamed("virtual_slot", "_vs"), "_vs")
    before = Window.partitionBy("shard").orderBy("_vs", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_vs")
    placed = placed.select("_vs", "_cell", "shard", "grown", "v1", F.sum("_bytes").over(whole).alias("slot_bytes"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_vs", "_cell").orderBy("_k", "_size", "_crc")
    numbered = rows.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(placed, ["_vs", "_cell"]).select(
        F.col("_k").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_base") + F.col("_r")).cast("long").alias("slot"),
        F.col("grown").cast("int").alias("grown_shard"),
        F.col("_vs").alias("virtual_slot"),
        "slot_bytes",
        F.col("v1").cast("int").alias("map_version"),
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), "doc_id", "text", shards=16)


OP6_SQL = f"""
WITH RECURSIVE crc_table(n, k, v) AS (
  SELECT n::BIGINT, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM crc_table WHERE k < 8
), tab AS (SELECT list(v ORDER BY n) AS t FROM crc_table WHERE k = 8),
src AS (
  SELECT doc_id, coalesce(text, '') AS body, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), sized AS (
  SELECT doc_id, h, octet_length(encode(body))::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT FOR i IN range(length(hx) // 2)]),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT doc_id, h, body, hex(encode(body)) AS hx FROM src), tab
), slotted AS (
  SELECT doc_id, size, text_crc32, (('0x' || substr(h, 1, 8))::BIGINT % {SLOTS})::INT AS virtual_slot,
    (('0x' || substr(h, 9, 8))::BIGINT % {CELLS})::INT AS cell FROM sized
), m0 AS (SELECT s::INT AS virtual_slot, (s % 16)::INT AS shard FROM range({SLOTS}) t(s)),
m1 AS (
  SELECT virtual_slot, shard, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY virtual_slot DESC)
    <= count(*) OVER (PARTITION BY shard) // 17 THEN 16 ELSE shard END::INT AS grown_shard FROM m0
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, cell, doc_id, size, text_crc32) - 1 AS slot,
  grown_shard, virtual_slot, (sum(size) OVER (PARTITION BY virtual_slot))::BIGINT AS slot_bytes, 1 AS map_version
FROM slotted JOIN m1 USING (virtual_slot)
"""
