"""Licence scans: TF-IDF cosine of headers to notices and of whole texts to full licences, and inheritance from the nearest directory with a licence file.

All of it is column expressions and joins of directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill, table

#: Notices by licence (SPDX names); fixed values.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Least cosine of a match, and the share of its text that a licence file's notices have at least.
COSINE, FILE_SHARE = 0.75, 0.5
#: Least cosine of a whole text to a full licence.
FILE_COSINE = 0.85
#: Words without weight; fixed values.
STOP = frozenset("a an and any are by for in into is of or the this to under v with without work".split())
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Headers end at line ends and at the ends of sentences.
CUT = r"\n|(?<=[.!?])[ \t\r\f]+"


class Vectors:
    """TF-IDF vectors of the templates. Inverse document frequencies are those of the templates; a token that
    none has weighs as much as one that no template would have."""

    def __init__(self, templates=TEMPLATES, cosine: float = COSINE):
        self.names = [n for n, _ in templates]
        bags = [Counter(w for w in re.findall(TOKEN, t.lower()) if w not in STOP) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        n = len(bags)
        self.other = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.vectors = [{w: c * self.idf[w] for w, c in sorted(b.items())} for b in bags]
        self.norms = [math.sqrt(sum(x * x for x in v.values())) for v in self.vectors]
        self.anchors = sorted({w for v, m in zip(self.vectors, self.norms, strict=True) for w in self._anchors(v, m, cosine)})

    @staticmethod
    def _anchors(vector: dict[str, float], norm: float, cosine: float) -> list[str]:
        """The heaviest tokens without which no text can reach the cosine: what is left of the template is too short for that."""
        taken, left = [], norm * norm
        for w, x in sorted(vector.items(), key=lambda kv: (-kv[1], kv[0])):
            if math.sqrt(max(left, 0)) < cosine * norm - 1e-9:
                break
            taken.append(w)
            left -= x * x
        return taken

    def pattern(self) -> str:
        """What a header with the cosine must hold."""
        return r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in self.anchors) + r")(?:[^a-z0-9]|$)"

    def best(self, header: Column) -> Column:
        """struct(score, license) of the nearest template; of equal ones the last name. Null scores are 0."""
        tokens = F.filter(F.regexp_extract_all(F.lower(header), F.lit(TOKEN), 0), lambda w: ~w.isin(*sorted(STOP)))
        idf = F.create_map(*[F.lit(x) for kv in sorted(self.idf.items()) for x in kv])

        def weighted(w):
            tf = F.size(F.filter(tokens, lambda y: y == w)).cast("double")
            return F.struct(w.alias("w"), (tf * F.coalesce(F.try_element_at(idf, w), F.lit(self.other))).alias("x"))

        def scored(vec):
            norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v["x"] * v["x"]))
            scores = []
            for name, vector, own in zip(self.names, self.vectors, self.norms, strict=True):
                dot = F.aggregate(vec, F.lit(0.0), _dot(vector))
                scores.append(F.struct(F.when(norm > 0, F.round(dot / (F.when(norm > 0, norm) * own), 6)).otherwise(0.0).alias("score"), F.lit(name).alias("license")))
            return F.array_max(F.array(*scores))

        # The vector is made once, as the one element of an array.
        return F.element_at(F.transform(F.array(F.transform(F.array_distinct(tokens), weighted)), scored), 1)


def _dot(vector: dict[str, float]):
    known = F.create_map(*[F.lit(x) for kv in vector.items() for x in kv])
    return lambda s, v: s + v["x"] * F.coalesce(F.try_element_at(known, v["w"]), F.lit(0.0))


def headers(text: Column, vectors: Vectors, cosine: float = COSINE) -> Column:
    """The pieces of a text that can match a template: those with an anchor, and with so few different tokens that no
    template has, beside those that some have, that the cosine can be reached. Nothing else is left out."""
    room = (1 / cosine**2 - 1) * max(vectors.idf.values()) ** 2 / vectors.other**2

    def possible(h):
        tokens = F.filter(F.regexp_extract_all(F.lower(h), F.lit(TOKEN), 0), lambda w: ~w.isin(*sorted(STOP)))
        known = F.size(F.filter(tokens, lambda w: w.isin(*vectors.idf))).cast("double")
        others = F.size(F.filter(F.array_distinct(tokens), lambda w: ~w.isin(*vectors.idf)))
        return others <= room * known * known + 1e-6

    return F.filter(F.filter(F.split(text, CUT), lambda h: h.rlike(vectors.pattern())), possible)


@lru_cache(1)
def full_texts() -> tuple[tuple[str, str], ...]:
    """The full licences, by SPDX name."""
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def whole_files(texts: DataFrame, full: tuple[tuple[str, str], ...] | None = None, cosine: float = FILE_COSINE) -> DataFrame:
    """Rows (_key, _text) to rows (_key, whole) of those whose cosine to a full licence, all words of both taken together, is at
    least ``cosine``: struct(score, license) of the nearest, of equal ones the last name. Each key has one row."""
    import pyarrow as pa

    v = Vectors(full_texts() if full is None else full, cosine)
    words = sorted(v.idf)
    weights = {"_w": pa.array(words, pa.string()), "_idf": pa.array([v.idf[w] for w in words], pa.float64())}
    weights |= {f"_t{k}": pa.array([t.get(w, 0.0) for w in words], pa.float64()) for k, t in enumerate(v.vectors)}
    weights = texts.sparkSession.createDataFrame(pa.table(weights))
    tokens = texts.where(F.col("_text").rlike(v.pattern())).select("_key", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(TOKEN), 0)).alias("_w"))
    counts = tokens.where(~F.col("_w").isin(*sorted(STOP))).groupBy("_key", "_w").agg(F.count("*").cast("double").alias("n"))
    x = F.col("n") * F.coalesce("_idf", F.lit(v.other))
    sums = counts.join(F.broadcast(weights), "_w", "left").groupBy("_key").agg(F.sqrt(F.sum(x * x)).alias("norm"), *[F.coalesce(F.sum(x * F.col(f"_t{k}")), F.lit(0.0)).alias(f"d{k}") for k in range(len(v.names))])
    scores = [F.struct(F.round(F.col(f"d{k}") / (F.col("norm") * own), 6).alias("score"), F.lit(name).alias("license")) for k, (name, own) in enumerate(zip(v.names, v.norms, strict=True))]
    return sums.select("_key", F.array_max(F.array(*scores)).alias("whole")).where(F.col("whole.score") >= cosine)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, cosine: float = COSINE, full: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """A row for each row of files: doc_id, path, license, score, n_headers, is_file, inherited, from_dir.

    ``license`` is that of the full licence that the whole text is most like, if that cosine is at least FILE_COSINE;
    else that of the header most like a template, if its cosine is at least ``cosine``; else the one of
    the nearest directory above that has a licence file (``inherited`` is then true and ``from_dir`` the
    directory). A licence file is like a full licence (``full``, by default full_texts()), or its matching headers are at
    least half of its text; of several in a directory the one with the greatest score counts, then the last name. Null and empty texts have no header, a null path is in no
    directory and inherits nothing. Repeated rows get a row each. Columns other than the three named are not read.
    """
    vectors = Vectors(templates, cosine)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = files.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), text.alias("_text"))
    found = F.filter(F.transform(headers(F.col("_text"), vectors, cosine), lambda h: F.struct(vectors.best(h).alias("b"), F.length(h).alias("n"))), lambda m: m["b"]["score"] >= cosine)
    found = F.when(F.col("_text").rlike(vectors.pattern()), found)
    # Texts that may be full licences are kept, until their cosines are known.
    likely = F.col("_text").rlike(Vectors(full_texts() if full is None else full, FILE_COSINE).pattern())
    # A generator keeps the optimizer from writing the expression out once for each of its uses below.
    read = own.select("_id", "_path", "_text", F.length("_text").alias("_len"), F.explode(F.array(F.struct(found.alias("m"), likely.alias("t")))).alias("_f"))
    read = spill(read.select("_id", "_path", "_len", "_f", F.when(F.col("_f.t"), F.col("_text")).alias("_text")).withColumn("_key", F.monotonically_increasing_id()), "license-texts")
    whole = whole_files(read.where("_text is not null").select("_key", "_text"), full)
    rows = read.select("_id", "_path", "_len", "_key", "_f")
    best, size = F.array_max(F.transform("_f.m", lambda m: m["b"])), F.aggregate("_f.m", F.lit(0), lambda s, m: s + m["n"])
    folder = F.when(F.col("_path").contains("/"), F.regexp_replace("_path", "/[^/]*$", ""))
    rows = rows.join(whole, "_key", "left")
    rows = rows.select(
        "_id", "_path", folder.alias("_dir"), F.coalesce(F.col("whole"), best)["license"].alias("_lic"), F.coalesce(F.col("whole"), best)["score"].alias("_score"),
        F.greatest(F.coalesce(F.size("_f.m"), F.lit(0)), F.lit(0)).alias("_n"), (F.col("whole").isNotNull() | F.coalesce(size >= FILE_SHARE * F.col("_len"), F.lit(False))).alias("_file"),
    ).withColumn("_file", F.col("_file") & F.col("_lic").isNotNull())
    rows = spill(rows, "license-rows")
    marks = rows.where(F.col("_file") & F.col("_dir").isNotNull()).groupBy("_dir").agg(F.max(F.struct("_score", "_lic"))["_lic"].alias("_there"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    seeking = rows.where(F.col("_lic").isNull() & F.col("_dir").isNotNull()).select("_dir").distinct().select("_dir", F.explode(above).alias("a"))
    near = seeking.join(marks.withColumnsRenamed({"_dir": "_up"}), F.col("a.up") == F.col("_up")).groupBy("_dir").agg(F.max(F.struct("a.depth", "_up", "_there")).alias("x"))
    near = near.select(F.col("_dir").alias("_of"), F.col("x._up").alias("_up"), F.col("x._there").alias("_there"))
    out = rows.join(near, (F.col("_dir") == F.col("_of")) & F.col("_lic").isNull(), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_path").alias(path_col), F.coalesce("_lic", "_there").alias("license"), "_score", F.col("_n").cast("long").alias("n_headers"),
        F.col("_file").alias("is_file"), (F.col("_lic").isNull() & F.col("_there").isNotNull()).alias("inherited"), F.col("_up").alias("from_dir"),
    ).withColumnRenamed("_score", "score")


def document_path() -> Column:
    """A place for each document: its source, and folders of ten thousand and of a hundred ids."""
    i = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 10_000).cast("string"), F.floor(i / 100).cast("string"), F.concat(i.cast("string"), F.lit(".txt")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", document_path().alias("path"), "text"))


def _sql() -> str:
    """The scan of documents in DuckDB SQL, every header against every template."""
    v = Vectors()
    idf = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(v.idf.items()))
    weights = ", ".join(f"({k}, '{w}', {x!r}::DOUBLE)" for k, t in enumerate(v.vectors) for w, x in t.items())
    names = ", ".join(f"({k}, '{n}', {x!r}::DOUBLE)" for k, (n, x) in enumerate(zip(v.names, v.norms, strict=True)))
    stop = ", ".join(f"'{w}'" for w in sorted(STOP))
    return rf"""
WITH idf(w, x) AS (VALUES {idf}), weight(k, w, x) AS (VALUES {weights}), template(k, name, norm) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), doc_id // 10000, doc_id // 100) AS dir FROM documents),
cut AS (SELECT r, string_split(regexp_replace(text, '([.!?])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS hs FROM d),
h AS (SELECT r, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM cut),
t AS (SELECT r, i, w, count(*) AS n FROM (SELECT r, i, unnest(regexp_extract_all(lower(h), '{TOKEN}')) AS w FROM h) WHERE w NOT IN ({stop}) GROUP BY r, i, w),
vec AS (SELECT r, i, t.w, n * coalesce(x, {v.other!r}) AS x FROM t LEFT JOIN idf USING (w)),
norm AS (SELECT r, i, sqrt(sum(x * x)) AS norm FROM vec GROUP BY r, i),
score AS (SELECT r, i, name, round(sum(vec.x * weight.x) / (any_value(norm.norm) * any_value(template.norm)), 6) AS s FROM vec JOIN weight USING (w) JOIN template USING (k) JOIN norm USING (r, i) GROUP BY r, i, k, name),
best AS (SELECT r, i, max({{'s': s, 'l': name}}) AS b FROM score WHERE s >= {COSINE} GROUP BY r, i),
own AS (SELECT r, max(b) AS b, count(*) AS n, sum(length(h.h)) AS size FROM best JOIN h USING (r, i) GROUP BY r),
f AS (SELECT d.*, b.l AS lic, b.s AS score, coalesce(n, 0) AS n, coalesce(size >= {FILE_SHARE} * length(text), false) AS is_file FROM d LEFT JOIN own USING (r)),
mark AS (SELECT dir, max({{'s': score, 'l': lic}}).l AS there FROM f WHERE is_file GROUP BY dir),
near AS (SELECT a.dir, max({{'d': depth, 'u': up, 't': there}}) AS x FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS up
  FROM (SELECT DISTINCT dir FROM f WHERE lic IS NULL), range(1, 4) g(depth)) a JOIN mark m ON a.up = m.dir GROUP BY a.dir)
SELECT doc_id, f.dir || '/' || doc_id || '.txt' AS path, coalesce(lic, x.t) AS license, score, n AS n_headers, is_file, lic IS NULL AND x IS NOT NULL AS inherited, CASE WHEN lic IS NULL THEN x.u END AS from_dir
FROM f LEFT JOIN near ON f.dir = near.dir
"""


OP5_SQL = _sql()
