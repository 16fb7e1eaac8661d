"""Logical tables of the engine, derived from stored event, conversation and embedding tables; times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Speaker numbers of the conversation roles.
ROLES = {"system": 0, "user": 1, "assistant": 2}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(events: DataFrame) -> DataFrame:
    """(file, i, p): a probability for each frame of a file, in the order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("file"),
        (F.row_number().over(w) - 1).cast("long").alias("i"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("p"),
    )


def words(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, pos, w, start_ms, end_ms): the words of a conversation on a regular clock."""
    cut = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    w = Window.partitionBy("conv_id").orderBy("turn", "k")
    flat = conversations.select("conv_id", "turn", "role", F.posexplode(cut).alias("k", "w")).where("w <> ''")
    placed = flat.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    start = F.col("pos") * 400 + F.col("turn") * 700
    return placed.select("conv_id", "turn", "role", "pos", "w", start.alias("start_ms"), (start + 320).alias("end_ms"))


def speaker_of(role):
    return F.coalesce(*[F.when(role == r, F.lit(n)) for r, n in ROLES.items()]).cast("long")


def spans(word_rows: DataFrame) -> DataFrame:
    """(conv_id, turn, speaker, start_ms, end_ms, text): one row for each turn."""
    return word_rows.groupBy("conv_id", "turn", "role").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"),
    ).withColumn("speaker", speaker_of(F.col("role")))


def turns(word_rows: DataFrame, before: int = 250, after: int = 1500) -> DataFrame:
    """(conv_id, idx, start_ms, end_ms, speaker): the turns but every fourth, moved by the paddings, so that neighbours overlap."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    kept = word_rows.where("turn % 4 <> 3").groupBy("conv_id", "turn", "role").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    return kept.select(
        "conv_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("s") + before).alias("start_ms"),
        (F.col("e") + after).alias("end_ms"), speaker_of(F.col("role")).alias("speaker"),
    )


def regions(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, start_ms, end_ms): where a turn and the one after it overlap."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    both = turn_rows.select("conv_id", F.greatest("start_ms", F.lead("start_ms").over(w)).alias("start_ms"), F.least("end_ms", F.lead("end_ms").over(w)).alias("end_ms"), F.lead("idx").over(w).alias("after"))
    return both.where("after is not null and start_ms < end_ms").drop("after")


def kernel_events(events: DataFrame) -> DataFrame:
    """(file, provider, dur_us): events as kernel times."""
    return events.select(F.col("user_id").alias("file"), F.col("event_type").alias("provider"), F.floor(F.col("value") * 1000).alias("dur_us"))


def logits(embeddings: DataFrame, classes: int = 7, rows: int = 9) -> DataFrame:
    """(file, frame, x): the first 63 numbers of a vector as nine frames of seven classes."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda f: F.slice("embedding", f * classes + 1, classes))
    return embeddings.select(F.col("vec_id").alias("file"), F.posexplode(cut).alias("frame", "x"))


#: The same tables in DuckDB SQL, to be put before an oracle's own query.
FRAMES = "frames AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, round(least(value / 100, 1.0), 4) AS p FROM events)"
WORDS = """flat AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS w,
    generate_subscripts(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), 1) AS k FROM conversations),
  placed AS (SELECT conv_id, turn, role, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS pos FROM flat WHERE w <> ''),
  words AS (SELECT conv_id, turn, role, pos, w, pos * 400 + turn * 700 AS start_ms, pos * 400 + turn * 700 + 320 AS end_ms FROM placed)"""
_SPEAKER = "(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END)::BIGINT"
SPANS = f"spans AS (SELECT conv_id, turn, {_SPEAKER} AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(w, ' ' ORDER BY pos) AS text FROM words GROUP BY conv_id, turn, role)"


def turns_sql(before: int = 250, after: int = 1500, name: str = "turns") -> str:
    return f"""{name} AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, s + {before} AS start_ms, e + {after} AS end_ms, speaker
  FROM (SELECT conv_id, turn, {_SPEAKER} AS speaker, min(start_ms) AS s, max(end_ms) AS e FROM words WHERE turn % 4 <> 3 GROUP BY conv_id, turn, role))"""


REGIONS = """regions AS (SELECT * FROM (SELECT conv_id, greatest(start_ms, lead(start_ms) OVER w) AS start_ms, least(end_ms, lead(end_ms) OVER w) AS end_ms, lead(idx) OVER w AS after
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY idx)) WHERE after IS NOT NULL AND start_ms < end_ms)"""
