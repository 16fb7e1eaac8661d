"""Transcripts as text: Markdown, JSON, plain text, SubRip and WebVTT, one string for each file.

Segments are rows (key, id, start_s, end_s, text, speaker, speakers, overlap): speaker is a label or null. Headers
are rows (key, file, duration_s, language, model, device, text); ``text`` is the file's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cue, clock, spoken, strip


def co_speakers() -> Column:
    """The other speakers of an overlapping segment; null if there are none."""
    others = F.array_join(F.slice("speakers", 2, F.greatest(F.size("speakers") - 1, F.lit(0))), ", ")
    return F.when(F.col("overlap") & (F.size("speakers") > 1), others)


def _joined(line: Column, mark: str) -> Column:
    """The lines of a file in the order of their segments, as an aggregate; null lines are left out."""
    listed = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("id", line.alias("l")))))
    return F.array_join(F.transform(listed, lambda x: x["l"]), mark)


def _lead(before: str, after: str, co_before: str, co_after: str) -> Column:
    named = F.concat(F.lit(before), F.col("speaker"), F.coalesce(F.concat(F.lit(co_before), co_speakers(), F.lit(co_after)), F.lit("")), F.lit(after))
    return F.coalesce(named, F.lit(""))


def srt(segments: DataFrame, key: str) -> DataFrame:
    """(key, body): numbered cues; blank ones are skipped before numbering. A file without cues has an empty body."""
    cues = segments.withColumn("_t", clean_cue(F.col("text")))
    some = F.col("_t") != ""
    cues = cues.withColumn("_n", F.sum(F.when(some, 1)).over(Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    line = F.concat(F.col("_n").cast("string"), F.lit("\n"), clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.lit("\n"), _lead("", ": ", " [+", "]"), F.col("_t"), F.lit("\n\n"))
    return cues.groupBy(key).agg(_joined(F.when(some, line), "").alias("body"))


def vtt(segments: DataFrame, key: str) -> DataFrame:
    cues = segments.withColumn("_t", clean_cue(F.col("text")))
    voice = F.coalesce(F.concat(F.lit("<v "), F.col("speaker"), F.lit(">")), F.lit(""))
    line = F.concat(clock(F.col("start_s"), "."), F.lit(" --> "), clock(F.col("end_s"), "."), F.lit("\n"), voice, F.col("_t"), F.lit("\n\n"))
    return cues.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), _joined(F.when(F.col("_t") != "", line), "")).alias("body"))


def _named() -> Column:
    return F.bool_or(F.col("speaker").isNotNull()).alias("named")


def txt(segments: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """A line for each segment if any has a speaker, else the file's text as it is."""
    line = F.concat(F.coalesce(F.concat(F.col("speaker"), F.lit(": ")), F.lit("")), strip(F.col("text")))
    rows = headers.select(key, "text").join(segments.groupBy(key).agg(_named(), _joined(line, "\n").alias("body")), key, "left")
    return rows.select(key, F.when(F.col("named"), F.col("body")).otherwise(strip(F.col("text"))).alias("body"))


def md(segments: DataFrame, headers: DataFrame, key: str, timestamps: bool = False) -> DataFrame:
    stamp = F.concat(F.lit("`["), spoken(F.col("start_s")), F.lit(" → "), spoken(F.col("end_s")), F.lit("]` ")) if timestamps else F.lit("")
    line = F.concat(stamp, _lead("**", ":** ", " (+", ")"), strip(F.col("text")), F.lit("\n\n"))
    rows = headers.join(segments.groupBy(key).agg(_named(), _joined(line, "").alias("body")), key, "left")
    title = F.when(F.coalesce("file", F.lit("")) == "", F.lit("Transcripción")).otherwise(F.col("file"))
    language = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit("- **Idioma:** "), F.col("language"), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("# Transcripción — "), title, F.lit("\n\n- **Modelo:** "), F.col("model"), F.lit(" ("), F.col("device"), F.lit(")\n"), language, F.lit("- **Duración:** "), spoken(F.col("duration_s")), F.lit("\n\n"))
    listed = F.lit(timestamps) | F.coalesce("named", F.lit(False))
    return rows.select(key, F.concat(head, F.when(listed, F.coalesce("body", F.lit(""))).otherwise(F.concat(strip(F.col("text")), F.lit("\n")))).alias("body"))


def document(segments: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """The nested form (key, doc): nulls, empty lists and a false overlap are null, so that JSON leaves them out."""
    words = F.col("words") if "words" in segments.columns else F.array().cast("array<struct<text:string,start:double,end:double,confidence:double>>")
    some = lambda c: F.when(F.size(c) > 0, c)
    seg = F.struct("id", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "speaker", some(F.col("speakers")).alias("speakers"), F.when(F.col("overlap"), F.lit(True)).alias("overlap"), some(words).alias("words"))
    listed = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", seg.alias("s")))).alias("_s")).select(key, F.transform("_s", lambda x: x["s"]).alias("segments"))
    rows = headers.join(listed, key, "left")
    doc = F.struct(
        F.lit("1.0").alias("version"), F.struct("file", "duration_s", "language").alias("source"),
        F.struct(F.col("model").alias("name"), "device").alias("model"), F.coalesce("segments", F.array()).alias("segments"), "text",
    )
    return rows.select(key, doc.alias("doc"))


def json(segments: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    return document(segments, headers, key).select(key, F.to_json("doc", {"pretty": "true"}).alias("body"))


def render(segments: DataFrame, headers: DataFrame, key: str, fmt: str, timestamps: bool = False) -> DataFrame:
    """One of the formats md, json, txt, srt and vtt: (key, body)."""
    forms = {"md": lambda: md(segments, headers, key, timestamps), "json": lambda: json(segments, headers, key), "txt": lambda: txt(segments, headers, key), "srt": lambda: srt(segments, key), "vtt": lambda: vtt(segments, key)}
    if fmt not in forms:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(forms)}")
    return forms[fmt]()
