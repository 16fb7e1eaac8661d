"""Benchmark decontamination: an inverted BM25 index of the test items, queried by every passage of every document.

The items are few and are the index; the passages of the training texts are the queries. Scores are divided by
the item's own (what the item as a query would get), so one threshold serves all items. Retrieval is block-max
WAND and returns every item at or above the threshold: blocks whose bound stays below it are skipped, for all
passages of a text at once, and pivots skip items in the blocks left. Matches are then verified by the overlap
of the item's question and answer with the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill, table, take_over, text_bytes

K1, B = 1.2, 0.75
#: Blocks of the index, each with neighbours by length.
BLOCKS = 128
#: Share of an item's own score that a passage needs; 5-word shingles and words that must recur.
RETRIEVE, SHINGLE, OVERLAP = 0.6, 5, 0.8
#: The index is built for so many items at a time; more items are searched in several passes.
ITEMS = 4000

words_of = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; a single sentence is cut at four fifths."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s.lower()))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    at = (4 * len(words) + 4) // 5
    return words[:at], words[at:]


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@dataclass
class Item:
    id: int
    question: list[str]
    answer: list[str]

    def overlaps(self, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's shingles, and of the answer's words, that the passage has. An empty part counts as found."""
        want = shingles(self.question)
        have = shingles(passage) if len(self.question) >= SHINGLE else {tuple(passage[i : i + len(self.question)]) for i in range(len(passage))}
        q = len(want & have) / len(want) if want else 1.0
        need = Counter(self.answer)
        got = need & Counter(passage)
        return q, sum(got.values()) / sum(need.values()) if need else 1.0


@dataclass
class Index:
    """Postings by term: items in order of length, and their impacts. The items fall into blocks of neighbours, which have
    bounds: ``rare[b, t]`` is the greatest impact of a rare term in block b (0 for a frequent one), ``rest[b]`` the greatest
    sum of what frequent terms add to one of its items."""

    items: list[Item]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    rare: object
    rest: object
    is_rare: object
    size: int
    longest: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], df: dict[str, int], n: int, mean_length: float) -> Index:
        """df, n and mean_length are those of the whole benchmark, of which items may be a part."""
        import numpy as np

        made = [Item(i, *question_and_answer(t)) for i, t in items]
        made = sorted((x for x in made if x.question or x.answer), key=lambda x: len(x.question) + len(x.answer))
        terms: dict[str, int] = {}
        postings: list[tuple[list[int], list[float]]] = []
        for at, item in enumerate(made):
            tf = Counter(item.question + item.answer)
            long = K1 * (1 - B + B * sum(tf.values()) / mean_length)
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + long) for w, c in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                if (t := terms.setdefault(w, len(postings))) == len(postings):
                    postings.append(([], []))
                postings[t][0].append(at)
                postings[t][1].append(x / own)
        size = max(1, -(-len(made) // BLOCKS))
        blocks = max(1, -(-len(made) // size))
        is_rare = np.array([len(p[0]) <= max(4, n // 50) for p in postings] + [False])
        rare, rest = np.zeros((blocks, len(postings) + 1), np.float32), np.zeros(len(made) + 1)
        for t, (where, impacts) in enumerate(postings):
            if is_rare[t]:
                np.maximum.at(rare[:, t], np.array(where) // size, np.array(impacts, np.float32))
            else:
                rest[where] += impacts
        rest = np.array([rest[b * size : (b + 1) * size].max(initial=0.0) for b in range(blocks)])
        return cls(made, terms, postings, np.ascontiguousarray(rare.T), rest, is_rare, size, max((len(x.question) + len(x.answer) for x in made), default=0))

    def search(self, query: list[int], least: float, block: int) -> list[tuple[int, float]]:
        """WAND within a block: (item, score) of its items with a score of ``least`` or more. query: distinct terms."""
        least -= 1e-9  # sums in another order may differ by so much
        first, end = block * self.size, (block + 1) * self.size
        cursors = []  # items, impacts, place, stop, greatest impact
        for t in query:
            where, impacts = self.postings[t]
            lo = bisect_left(where, first)
            if lo < (hi := bisect_left(where, end, lo)):
                cursors.append([where, impacts, lo, hi, max(impacts[lo:hi])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]])
            bound = 0.0
            for c in cursors:
                bound += c[4]
                if bound >= least:
                    break
            else:
                break
            item = c[0][c[2]]  # no item before this pivot can reach the threshold
            if cursors[0][0][cursors[0][2]] == item:
                score = sum(c[1][c[2]] for c in cursors if c[0][c[2]] == item)
                if score >= least:
                    found.append((item, score))
                item += 1
            for c in cursors:
                while c[2] < c[3] and c[0][c[2]] < item:
                    c[2] += 1
            cursors = [c for c in cursors if c[2] < c[3]]
        return found

    def passages(self, words: list[str], least: float) -> Iterator[tuple[int, list[int], list[int]]]:
        """Where a passage begins, its distinct terms and the blocks whose bound reaches the threshold, if any does.

        Passages have twice the words of the longest item and begin every so many words as that item has, so
        any stretch of an item's length lies in one of them. The bounds of all passages and blocks are taken at
        once, from the sums of the halves of the passages.
        """
        import numpy as np

        step, none = self.longest, len(self.postings)
        ids = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
        cells = -(-len(words) // step)
        at = np.flatnonzero(self.is_rare[ids])
        pairs = np.unique(at // step * (none + 1) + ids[at])
        sums = np.zeros((cells + 1, len(self.rest)), np.float32)
        if len(pairs):
            cell, starts = np.unique(pairs // (none + 1), return_index=True)
            for i in range(0, len(cell), 256):  # a part at a time: the texts may be long
                lo, hi = starts[i], starts[i + 256] if i + 256 < len(cell) else len(pairs)
                sums[cell[i : i + 256]] = np.add.reduceat(self.rare[pairs[lo:hi] % (none + 1)], starts[i : i + 256] - lo, axis=0)
        hits = sums[:-1] + sums[1:] + self.rest >= least - 1e-5
        for k in np.flatnonzero(hits.any(1)).tolist():
            query = np.unique(ids[k * step : (k + 2) * step])
            query = query[query < none]
            blocks = np.flatnonzero(hits[k])
            bounds = self.rare[query][:, blocks].sum(0) + self.rest[blocks]
            if len(blocks := blocks[bounds >= least - 1e-5]):
                yield k * step, query.tolist(), blocks.tolist()

    def matches(self, text: str, least: float = RETRIEVE, overlap: float = OVERLAP) -> list[tuple[int, float, float, float, int]]:
        """The verified items of a text: (item id, best score, question overlap, answer overlap, first word of the passage)."""
        words = words_of(text.lower())
        best: dict[int, tuple] = {}
        if not words or not self.items:
            return []
        for s, query, blocks in self.passages(words, least):
            passage = words[s : s + 2 * self.longest]
            for at, score in (x for b in blocks for x in self.search(query, least, b)):
                q, a = self.items[at].overlaps(passage)
                if q >= overlap and a >= overlap and (at not in best or (q + a, score) > (best[at][2] + best[at][3], best[at][1])):
                    best[at] = (self.items[at].id, score, q, a, s)
        return sorted(best.values(), key=lambda m: (m[0] is None, m[0] or 0, m[4]))


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = ITEMS) -> Iterator[Index]:
    """The index of the benchmark, in parts of about ``items`` items, drawn by a hash of id and text; the driver builds one at a time.

    An item without words (or null) has nothing to find; a null id is kept as null. Repeated items are found
    each. Statistics (item frequencies of words, mean length) are over all items.
    """
    own = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = own.count()
    passes = max(1, -(-n // items))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(passes))
    # The words are counted where they are; only those of one part come to the driver.
    words = spill(own.mapInPandas(_item_words, "i long, t string, w array<string>").withColumn("p", part), "benchmark")
    mean = (words.agg(F.sum(F.size("w"))).first()[0] or 0) / max(n, 1) or 1.0
    df = words.select("p", F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.collect_set("p").alias("ps"))
    df = spill(df, "benchmark-df") if passes > 1 else df
    for p in range(passes):
        rows = words.where(F.col("p") == p).select("i", "t").orderBy("i", "t").collect()
        counts = dict(df.where(F.array_contains("ps", F.lit(p).cast("long"))).select("w", "n").collect())
        yield Index.build([(r.i, r.t) for r in rows], counts, n, mean)


def _item_words(frames):
    for f in frames:
        yield f.assign(w=[[w for part in question_and_answer(t) for w in part] for t in f.t])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = RETRIEVE, overlap: float = OVERLAP, items: int = ITEMS) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap, at_word.

    Words are runs of letters, digits and underscores, lower-cased; so case, punctuation and line breaks don't hide
    a passage. A match needs ``overlap`` of the question's 5-word shingles and of the answer's words within one
    passage. Null and empty texts match nothing; repeated rows get their rows each; an empty benchmark finds
    nothing. Columns other than those named are not read, and documents are not shuffled.
    """
    schema = f"`{id_col}` long, `{item_col}` long, score double, question_overlap double, answer_overlap double, at_word long"
    own, out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), None
    for index in build_indexes(benchmark, item_col, item_text, items):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index  # the driver keeps it in a file

        def run(batches, sent=sent) -> Iterator:
            import pyarrow as pa

            take_over("decontam")
            index = sent.value
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for m in index.matches(t.decode(), least, overlap)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=[id_col, item_col, "score", "question_overlap", "answer_overlap", "at_word"],
                    )

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = RETRIEVE, overlap: float = OVERLAP, items: int = ITEMS) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay as they are. Nothing is shuffled."""
    place = docs.columns.index(text_col)
    for index in build_indexes(benchmark, item_col, item_text, items):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches, sent=sent) -> Iterator:
            import pyarrow as pa

            take_over("decontam")
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.matches(t.decode(), least, overlap) for t in text_bytes(batch.column(place))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
