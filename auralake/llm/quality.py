"""Quality by compression: a dictionary of good text and one of bad text, and which of them compresses a text better."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, kept, spill, table, take_over, text_bytes

#: Of each label, the sample takes so many rows at most (by a hash of the id) and stops after so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 12 << 20
DICT_BYTES, LEVEL = 64 << 10, 3
#: Every third row of the sample calibrates; dictionaries are built from the others.
CALIBRATE = 3
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries (bad, good) and the logistic curve over the size difference."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


@kept("quality")
def _compressors(bad: bytes, good: bytes):
    import zstandard as z

    made = []
    for raw in (bad, good):
        d = z.ZstdCompressionDict(raw) if raw else None
        if d:
            d.precompute_compress(level=LEVEL)
        made.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def difference(text: bytes, model: Model) -> float:
    """(size with the bad dictionary - size with the good one) / the mean of both; the empty text has 0."""
    if not text:
        return 0.0
    bad, good = (len(c.compress(text)) for c in _compressors(model.bad, model.good))
    return 2 * (bad - good) / (bad + good)


def probability(text: bytes, model: Model) -> float:
    x = model.slope * difference(text, model) + model.offset
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained by the library; of too few or too short samples, the dictionary is their own last bytes."""
    import zstandard as z

    # Long texts are cut into pieces, all of which count: the library weighs samples alike.
    samples = [t[i : i + 8192] for t in texts for i in range(0, len(t), 8192)]
    try:
        return z.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


def fit(rows: list[tuple[int, bytes]], share_good: float) -> Model:
    """The model of a labelled sample (label, text), in its order. share_good: the share of label 1 among all labelled rows."""
    import numpy as np

    learn = [[t for i, (y, t) in enumerate(rows) if y == k and i % CALIBRATE] for k in (0, 1)]
    model = Model(*(_dictionary(x) if x else b"" for x in learn), 0.0, 0.0)
    held = [(y, difference(t, model)) for i, (y, t) in enumerate(rows) if i % CALIBRATE == 0]
    prior = math.log((share_good + 1e-6) / (1 - share_good + 1e-6))
    if len({y for y, _ in held}) < 2:
        return Model(model.bad, model.good, 0.0, prior)
    y, x = np.array([h[0] for h in held], float), np.array([h[1] for h in held])
    weight = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    design, w = np.stack([x, np.ones_like(x)], 1), np.array([0.0, prior])
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + ridge @ w
        w -= np.clip(np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, grad), -20, 20)
    return Model(model.bad, model.good, float(w[0]), float(w[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model on a bounded sample of labelled rows whose fold (crc32 of the id as text, modulo folds) is not 0.

    The ids are drawn from the labels alone, by a hash, so that only the sample's texts are read to the driver,
    and of them no more than ``sample_bytes`` for each label. The share of good rows is that of all labels
    outside the held-out fold. An id labelled twice counts with its greatest label.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (id_fold(F.col(id_col), folds) != 0))
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .withColumn("_o", F.xxhash64("_id"))
    )
    count = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / sum(count.values()) if count else 0.5
    drawn = [known.where(F.col("_y") == y).orderBy("_o", "_id").limit(sample_rows) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    texts = spill(own.join(F.broadcast(ids), "_id"), "quality-sample")  # at most 2 * sample_rows ids
    rows, left = [], {0: sample_bytes, 1: sample_bytes}
    for r in texts.orderBy("_o", "_id", "_t").toLocalIterator():
        t = r._t.encode()
        if left[r._y] > 0 and t:
            left[r._y] -= len(t)
            rows.append((r._y, t))
    return fit(rows, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, accept: float = ACCEPT) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (the probability of label 1), predicted (1 from ``accept`` on).

    Whole texts are scored. Null and empty texts have no size difference and get the curve's value at 0. Repeated
    rows and rows with a null id (fold of the empty text) get a row each; other columns are not read.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("quality")
        for batch in batches:
            found = [probability(t, model) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(p >= accept) for p in found], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    own = docs.select(F.col(id_col).cast("long").alias(id_col), (id_fold(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("_t"))
    return own.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay as they are. Nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("quality")
        for batch in batches:
            yield batch.filter(pa.array([probability(t, model) >= accept for t in text_bytes(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
