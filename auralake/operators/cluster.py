"""Speakers from embeddings: cosine distances, average linkage and the cut of its tree.

Linkage compares all embeddings of one file, so it runs in a grouped pandas function by file. Its memory grows with a
file's embeddings (its speech segments), its time with their square.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine_of, dot

THRESHOLD, ELBOW = 0.55, 0.30


def pair_distances(vectors: DataFrame, key: str = "file", at: str = "i", vector: str = "x") -> DataFrame:
    """(key, i, j, d) for i < j of the same file. Norms are taken once a vector, not once a pair."""
    rows = vectors.select(key, F.col(at).alias("i"), F.col(vector).cast("array<double>").alias("x"))
    a = rows.select(key, "i", F.col("x").alias("a"), F.sqrt(dot(F.col("x"), F.col("x"))).alias("na"))
    b = a.select(key, F.col("i").alias("j"), F.col("a").alias("b"), F.col("na").alias("nb"))
    d = cosine_of(dot(F.col("a"), F.col("b")), F.col("na"), F.col("nb"))
    return a.join(b, key).where("i < j").select(key, "i", "j", d.alias("d"))


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up by the shortest decimal digits of the number."""
    from decimal import ROUND_HALF_UP, Decimal

    scale = 10.0**digits
    n = np.where(np.isfinite(d), np.abs(d), 0.0) * scale
    out = np.where(np.isfinite(d), np.sign(d) * np.floor(n + 0.5) / scale + 0.0, d)
    near = np.flatnonzero(np.abs(n % 1 - 0.5) < 1e-4)
    if len(near):
        some, at = np.unique(d[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in some])[at]
    return out


class _Block:
    """Vectors of one file: their matrix, norms summed in order, lengths (-1: no vector) and the rank of each one's number."""

    def __init__(self, packs: list):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.ids = pa.chunked_array([p.field("i") for p in packs]).combine_chunks()
        lists = pa.chunked_array([p.field("x") for p in packs]).combine_chunks()
        self.length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        self.x = np.zeros((len(lists), max(int(self.length.max()), 0)))
        self.x[np.arange(self.x.shape[1]) < self.length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self.rank = np.unique(self.ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        norm = np.sqrt(self.products(*[np.arange(len(lists))] * 2))
        self.low = (norm < 1e-8) & (self.length >= 0)
        self.norm = np.where(self.low, 1.0, norm)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for k in range(self.x.shape[1]):
            total += self.x[a, k] * self.x[b, k]
        return total

    def about(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows a to rows b by a product of matrices, right but for rounding; infinite where there is none, NaN unless a's number is the lesser."""
        d = 1 - (self.x[a] @ self.x[b].T) / np.outer(self.norm[a], self.norm[b])
        d[np.isnan(d) | (self.length[a][:, None] != self.length[b]) | (self.length[a] < 0)[:, None]] = np.inf
        d[self.low[a]], d[:, self.low[b]] = 1.0, 1.0
        return d

    def nearest(self, left: np.ndarray, right: np.ndarray, count: int, digits: int):
        """(row, row, distance, whether there is none) of the first ``count`` pairs of rows of left and right by (rounded distance,
        lesser number, greater number). Only pairs that can be among them are summed in order, which gives their distance itself."""
        far, slack = np.inf, 2 * 10.0**-digits
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        rank = self.rank
        for i in range(0, len(left), HELD):
            for j in range(0, len(right), HELD):
                a, b = left[i : i + HELD], right[j : j + HELD]
                d = self.about(a, b)
                d[rank[a][:, None] >= rank[b] if left is right else rank[a][:, None] == rank[b]] = np.nan
                some = d[d <= far]
                if len(some) > count:
                    far = min(far, float(np.partition(some, count - 1)[count - 1]) + slack)
                p, q = np.nonzero(d <= far)
                p, q = a[p], b[q]
                p, q = np.where(rank[p] < rank[q], p, q), np.where(rank[p] < rank[q], q, p)
                low = self.low[p] | self.low[q]
                exact = np.where(low, 1.0, 1 - self.products(p, q) / (self.norm[p] * self.norm[q]))
                p, q, exact, none = (np.concatenate(c) for c in zip(best, (p, q, exact, ~low & ((self.length[p] != self.length[q]) | (self.length[p] < 0))), strict=True))
                order = np.lexsort((rank[q], rank[p], _rounded(exact, digits), none))[:count]
                best = p[order], q[order], exact[order], none[order]
                if len(order) == count and not (best[3][-1] or np.isnan(best[2][-1])):
                    far = min(far, float(best[2][-1]) + slack)
        return best


#: Vectors of a block, and rows of it that are multiplied at once.
BLOCK, HELD = 2000, 500


def nearest_pairs(vectors: DataFrame, count: int, digits: int = 6, key: str = "file", at: str = "i", vector: str = "x", block: int = BLOCK) -> DataFrame:
    """(key, i, j, d) of the ``count`` first pairs i < j of each file by (d, i, j), with d rounded: the pairs of pair_distances, without a row for each.

    A file's vectors are dealt to blocks. Every two blocks, and every block by itself, are compared by products of matrices,
    and only the first pairs of each comparison leave it. Pairs without a distance (null) come last.
    """
    from .islands import number

    v = vectors.select(key, F.col(at).alias("i"), F.when(~F.exists(vector, lambda e: e.isNull()), F.col(vector)).alias("x")).dropna(subset=[key, "i"])
    large = v.groupBy(key).agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")  # one in ``block`` rows at most
    dealt = v.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    packs = dealt.withColumn("b", F.pmod(F.xxhash64("i"), "blocks")).groupBy(key, "blocks", "b").agg(F.collect_list(F.struct("i", "x")).alias("v"))
    packs = packs.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(key, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "v")
    types = dict(v.dtypes)

    def run(keys, found):
        import pyarrow as pa

        packs = [c[i].values for c in found.column("v").chunks for i in range(len(c))]
        one = keys[1] == keys[2]
        if not one and len(packs) < 2:  # nothing was dealt to the other block
            packs, one = [packs[0][:0]], True
        if one and not len(packs[0]):
            i = j = packs[0].field("i")
            d = pa.array([], pa.float64())
        else:
            at_once, n = _Block(packs), len(packs[0])
            every = np.arange(len(at_once.x))
            a, b, d, none = at_once.nearest(every, every, count, digits) if one else at_once.nearest(every[:n], every[n:], count, digits)
            i, j, d = at_once.ids.take(pa.array(a)), at_once.ids.take(pa.array(b)), pa.array(d, mask=none)
        return pa.table({key: pa.array([keys[0].as_py()] * len(d), keys[0].type), "i": i, "j": j, "d": d})

    pairs = packs.groupBy(key, "p", "q").applyInArrow(run, f"`{key}` {types[key]}, i {types['i']}, j {types['i']}, d double")
    first = number(pairs.withColumn("d", F.round("d", digits)), key, [F.col("d").asc_nulls_last(), "i", "j"], 1, "r")
    return first.where(F.col("r") <= count).select(key, "i", "j", "d")


def merge_count(steps: DataFrame, threshold: float = THRESHOLD, key: str = "file") -> DataFrame:
    """How many steps (key, step, height) of a linkage to take: (key, merges, elbow).

    Up to the greatest jump to a height of 0.30 or more, the first of a tie; without one, the leading steps up to the threshold.
    """
    w = Window.partitionBy(key).orderBy("step")
    rows = steps.withColumn("next", F.lead("height").over(w)).withColumn("jump", F.col("next") - F.col("height"))
    best = F.max(F.when((F.col("next") >= ELBOW) & (F.col("jump") > 0), F.struct(F.col("jump").alias("j"), (-F.col("step")).alias("s"))))
    over = F.min(F.when(F.col("height") > threshold, F.col("step")))
    return rows.groupBy(key).agg(best.alias("b"), over.alias("o"), F.count("*").alias("n")).select(
        key, F.coalesce(1 - F.col("b.s"), "o", "n").cast("long").alias("merges"), F.col("b").isNotNull().alias("elbow")
    )


def _distinct_units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(sums, sizes, least rows, pairs of rows alike): the vectors at length 1, equal ones taken together.

    A vector whose norm is below 1e-8 or no number is 0 and stays by itself, which puts it at distance 1 from all others.
    """
    norm = np.linalg.norm(x, axis=1)
    low = ~((norm >= 1e-8) & np.isfinite(norm))
    unit = np.where(low[:, None], 0.0, x / np.where(low, 1.0, norm)[:, None]) + 0.0
    seen: dict[object, int] = {}
    first = np.array([seen.setdefault(i if low[i] else unit[i].tobytes(), i) for i in range(len(x))])
    rows, at, size = np.unique(first, return_inverse=True, return_counts=True)
    return unit[rows] * size[:, None], size.astype(float), rows, [(int(first[i]), int(i)) for i in np.flatnonzero(first != np.arange(len(x)))]


def average_linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The steps of average linkage on cosine distance: members (by their least row) and height, least first.

    The mean distance of two clusters is 1 minus the product of the means of their vectors at length 1, so a cluster is its sum and
    its size, and no table of distances is held. Merges are found by chains of nearest neighbours, as in the reference's library.
    """
    sums, size, name, alike = _distinct_units(np.asarray(x, float))
    steps = [(a, b, 0.0) for a, b in alike]
    mean, alive, dead = sums / size[:, None], np.ones(len(sums), bool), 0
    chain: list[int] = []  # each one's nearest is the next one, ever nearer
    gaps: list[float] = []
    found, height = [], np.zeros(len(sums))
    for _ in range(len(sums) - 1):
        if not chain:
            chain, gaps = [int(np.argmax(alive))], []
        while True:
            d = 1 - mean @ mean[chain[-1]]
            d[~alive] = np.inf
            d[chain] = np.inf  # no earlier one is nearer than the last gap, rounding aside
            near = int(np.argmin(d))
            if gaps and not d[near] < gaps[-1]:
                break
            chain.append(near)
            gaps.append(float(d[near]))
        a, b = sorted((chain.pop(), chain.pop()), key=lambda i: name[i])
        h = max(gaps.pop(), height[a], height[b])  # rounding aside, heights never fall
        del gaps[len(chain) - 1 if chain else 0 :]
        found.append((int(name[a]), int(name[b]), float(h)))
        sums[a] += sums[b]
        size[a] += size[b]
        mean[a], height[a], alive[b], dead = sums[a] / size[a], h, False, dead + 1
        if dead > 256 and 2 * dead > len(alive):
            place = np.cumsum(alive) - 1
            chain = [int(place[i]) for i in chain]
            sums, size, name, mean, height = sums[alive], size[alive], name[alive], mean[alive], height[alive]
            alive, dead = np.ones(len(sums), bool), 0
    return steps + sorted(found, key=lambda step: step[2])


def cut(n: int, steps: list[tuple[int, int, float]], max_speakers: int | None, threshold: float = THRESHOLD) -> list[int]:
    """Labels after the steps that a fixed number of clusters, or the elbow rule, asks for; numbered by first appearance."""
    if max_speakers is not None:
        merges = n - min(max(max_speakers, 1), n)
    else:
        h = [s[2] for s in steps]
        jumps = [(h[i + 1] - h[i], -i) for i in range(len(h) - 1) if h[i + 1] >= ELBOW and h[i + 1] > h[i]]
        merges = 1 - max(jumps)[1] if jumps else next((i for i, v in enumerate(h) if v > threshold), len(h))
    root = list(range(n))
    for a, b, _ in steps[:merges]:
        root[b] = a
    for i in range(n):  # a step's first member is the lesser row
        root[i] = root[root[i]]
    first: dict[int, int] = {}
    return [first.setdefault(r, len(first)) for r in root]


def cluster(vectors: DataFrame, max_speakers: int | None = None, threshold: float = THRESHOLD, key: str = "file", at: str = "i", vector: str = "x") -> DataFrame:
    """(key, i, label): the speaker of each embedding; one embedding is speaker 0."""

    def run(pdf):
        pdf = pdf.sort_values(at)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        return pdf[[key, at]].assign(label=cut(len(x), average_linkage(x), max_speakers, threshold) if len(x) > 1 else [0])

    types = dict(vectors.dtypes)
    return vectors.select(key, at, vector).groupBy(key).applyInPandas(run, f"{key} {types[key]}, {at} {types[at]}, label long")


def turns_of(speech: DataFrame, labels: DataFrame, gap_ms: int = 500, key: str = "conv_id") -> DataFrame:
    """Speech (key, idx, start_ms, end_ms) with labels (key, idx, label), where both exist, as merged turns."""
    from .islands import coalesce_turns

    return coalesce_turns(speech.join(labels, [key, "idx"]).withColumnRenamed("label", "speaker"), gap_ms, key)
