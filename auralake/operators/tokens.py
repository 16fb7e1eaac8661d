"""Token ids and texts: vocabularies, id to text, words with times, byte-pair encoding and prompts."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PRETOKENS, is_special, prompt, strip, tail

MARK = "▁"
PROMPT_TOKENS = 200


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a text file of "token id" lines, cut at the last space; other lines are skipped."""
    parts = lambda n: F.regexp_extract("value", r"^(.*) (\d+)\s*$", n)
    return spark.read.text(path).where(F.col("value").rlike(r"^.* \d+\s*$")).select(parts(2).cast("long").alias("id"), parts(1).alias("token"))


def blank_id(vocabulary: DataFrame) -> DataFrame:
    """One row: the id of the blank mark, else the last id."""
    return vocabulary.agg(F.coalesce(F.min(F.when(F.col("token").isin("<blk>", "<blank>"), F.col("id"))), F.max("id")).alias("blank"))


def read_json_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of one JSON object of token: id."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "id"))
    return rows.select("id", "token")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, a, b) of a merge list: blank lines and those with # in front are skipped, the rank is the order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line", F.split(F.trim("value"), " ").alias("p")).where("size(p) >= 2")
    return kept.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line")) - 1).cast("long").alias("rank"), F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


def lookup(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows with an id, and the token of that id; unknown ids are dropped. The size of the vocabulary decides how they are joined."""
    return tokens.join(vocabulary, "id")


def decode(tokens: DataFrame, vocabulary: DataFrame, keys: list[str], at: str = "pos") -> DataFrame:
    """Token rows (*keys, at, id) as text (*keys, text): unknown ids and marks are dropped, the word mark is a space."""
    found = lookup(tokens, vocabulary).where(~is_special(F.col("token")))
    listed = F.array_sort(F.collect_list(F.struct(at, "token")))
    body = F.array_join(F.transform(listed, lambda x: x["token"]), "")
    return found.groupBy(*keys).agg(strip(F.replace(body, F.lit(MARK), F.lit(" "))).alias("text"))


def decode_words(tokens: DataFrame, key: str = "conv_id", at: str = "pos") -> DataFrame:
    """Token rows (key, at, token, frame) as words (key, word, text, first, last).

    A token with the word mark begins a word; a mark by itself is skipped, so the piece after it goes to the word before. Marks of
    the decoder are skipped as well. A word lasts from its first to its last token's frame.
    """
    kept = tokens.where(~is_special(F.col("token")) & (F.col("token") != MARK))
    w = Window.partitionBy(key).orderBy(at)
    starts = (F.col("token").startswith(MARK) | (F.row_number().over(w) == 1)).cast("int")
    rows = kept.withColumn("_s", starts).withColumn("word", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    listed = F.array_sort(F.collect_list(F.struct(at, "token")))
    body = F.replace(F.array_join(F.transform(listed, lambda x: x["token"]), ""), F.lit(MARK), F.lit(""))
    return rows.groupBy(key, "word").agg(body.alias("text"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def pretokens(text):
    """The pieces of a text that are encoded by themselves."""
    return F.regexp_extract_all(text, F.lit(PRETOKENS), 0)


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself if it is one, else the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge(piece: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Joins the neighbours of the lowest rank, leftmost first, until none has a rank."""
    parts = list(piece)
    while len(parts) > 1:
        rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = ["".join(parts[at : at + 2])]
    return parts


def encode_column(ranks: dict[tuple[str, str], int], ids: dict[str, int]):
    """A vectorised function from an array of pieces to token ids; unknown tokens are dropped."""
    sign = byte_alphabet()

    def encode(pieces):
        @lru_cache(100_000)
        def one(piece: str) -> tuple[int, ...]:
            return tuple(ids[t] for t in merge([sign[b] for b in piece.encode()], ranks) if t in ids)

        return pieces.map(lambda ps: [t for p in ps for t in one(p)])

    encode.__annotations__ = {"pieces": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "array<bigint>")


def decode_column(ids: dict[str, int]):
    """A vectorised function from token ids to text: ids that are absent are ignored, broken UTF-8 is replaced."""
    byte = {c: b for b, c in byte_alphabet().items()}
    tokens = {i: t for t, i in ids.items()}

    def decode_ids(rows):
        text = lambda r: "".join(tokens.get(i, "") for i in r)
        return rows.map(lambda r: bytes(byte[c] for c in text(r) if c in byte).decode("utf-8", "replace"))

    decode_ids.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode_ids, "string")


def prompt_tail(init, previous, n: int = PROMPT_TOKENS):
    """The last n white-space tokens of the prompt that both texts make."""
    return tail(F.filter(F.split(prompt(init, previous), r"\s+"), lambda t: t != ""), n)


def languages(codes: list[str]) -> dict[str, str]:
    """Language marks by code."""
    return {c: f"<|{c}|>" for c in codes}


def language_code(language, codes: dict[str, str], default: str = "auto"):
    """The code of a language id; the default for null and for ids that are not in ``codes``."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(known, language), F.lit(default))


def resolve_language(requested, known: list[str]):
    """The language that a request names: null for none or auto; marks around it and case don't count; unknown ones are errors."""
    code = F.lower(strip(F.regexp_replace(strip(requested), r"^<\||\|>$", "")))
    unset = requested.isNull() | code.isin("", "auto")
    return F.when(unset, F.lit(None).cast("string")).when(code.isin(*known), code).otherwise(F.raise_error(F.concat(F.lit("unknown language: "), code)).cast("string"))
