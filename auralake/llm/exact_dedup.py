"""Exact deduplication by Grace hashing: records go to spill files by hash until a bucket fits an open-addressing table.

Equality is that of the complete contents; hashes only choose the bucket and the table's slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, parts, spill, table, take_over, text_bytes

#: Bytes of distinct contents that one table may hold.
TABLE_BYTES = 48 << 20
#: Way of each recursive partitioning.
FANOUT = 64


class ContentTable:
    """Open addressing with linear probing over whole contents; entries are numbered in order of arrival."""

    def __init__(self, slots: int = 1 << 10):
        self.mask, self.slots = slots - 1, [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find_or_add(self, h: int, content: bytes) -> int:
        slots, mask, i = self.slots, self.mask, h & self.mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        slots[i] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


_LOCAL = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("rep", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("top", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _local_groups(limit: int):
    """Groups the equal texts of each input partition, before anything is shuffled.

    Yields a row for each document: its id, digest and the group's name; the group's first row also carries
    the content, the count and the largest id, all of which are known when the table is full or the input
    ends. A partition with more distinct contents than the limit makes several tables, one after the other.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("rep", pa.string()), ("n", pa.int64()), ("top", pa.int64()), ("content", pa.binary())])
        take_over("exact_dedup")
        task = TaskContext.get().partitionId()
        made = 0

        def flush():
            ids, shas, reps, ns, tops, contents = [], [], [], [], [], []
            for e, members in enumerate(groups):
                known = [m for m in members if m is not None]
                name = f"{task}.{made + e}"
                for j, m in enumerate(members):
                    ids.append(m)
                    shas.append(digests[e])
                    reps.append(name)
                    ns.append(len(members) if not j else None)
                    tops.append((max(known) if known else None) if not j else None)
                    contents.append(found.contents[e] if not j else None)
                    if len(ids) >= 2048 and j == len(members) - 1 or len(ids) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, shas, reps, ns, tops, contents), schema, strict=True)], schema=schema)
                        ids, shas, reps, ns, tops, contents = [], [], [], [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, shas, reps, ns, tops, contents), schema, strict=True)], schema=schema)

        found, groups, digests = ContentTable(), [], []
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                digest = hashlib.sha256(content)
                e = found.find_or_add(int.from_bytes(digest.digest()[:8], "big"), content)
                if e == len(groups):
                    groups.append([])
                    digests.append(digest.hexdigest())
                groups[e].append(doc)
                if found.bytes > limit:
                    yield from flush()
                    made += len(groups)
                    found, groups, digests = ContentTable(), [], []
        yield from flush()

    return run


def _merge_bucket(batches) -> Iterator:
    """One bucket's table: (sha, rep, n, top, content) rows to (rep, keep_id, group_size) rows."""
    import pyarrow as pa

    schema = pa.schema([("rep", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    take_over("exact_dedup")
    found, reps, sizes, tops = ContentTable(), [], [], []
    for batch in batches:
        for sha, rep, n, top, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            e = found.find_or_add(int(sha[:16], 16), content)
            if e == len(reps):
                reps.append([])
                sizes.append(0)
                tops.append(None)
            reps[e].append(rep)
            sizes[e] += n
            if top is not None and (tops[e] is None or top > tops[e]):
                tops[e] = top
    flat = [(r, tops[e], sizes[e]) for e, rs in enumerate(reps) for r in rs]
    for i in range(0, len(flat), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*flat[i : i + 8192], strict=True), schema, strict=True)], schema=schema)


def _digit(level: int):
    """The level's hash digit: 24 bits of the digest, from another place at each level."""
    return F.conv(F.substring("sha", 17 + 6 * level, 6), 16, 10).cast("long")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), a row for each row of df.

    A null text is the empty text. Of a group, the row with the largest id stays; null ids count as the
    smallest, and in a group of null ids alone nothing but null can be named, so keep_id is null and the
    rows are kept. Rows repeated with the same id and text are one group and share its fate: each has
    kept = true if its id is the largest. An empty table gives an empty result; columns other than the two
    named are not read.

    1. Each input partition groups its own equal texts in an open-addressing table and writes all rows to
       the first spill table; a content is there once for each partition, so a hot text shrinks before
       the shuffle.
    2. Records go to buckets by hash digits; a bucket whose distinct contents exceed ``table_bytes`` is
       partitioned again by the next digits, in a spill table of its own, until all fit (one content can't
       be split and is a table with one entry). The spill files lie in the shared folder.
    3. One table for each bucket compares complete contents and yields each local group's result, which
       joins back by the local group's name: a key that no more rows have than one partition.
    """
    spark = df.sparkSession
    local = spill(df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_local_groups(table_bytes // 2), _LOCAL).withColumn("b", F.octet_length("content") + 100), "dedup-l0")
    todo = local.where(F.col("b").isNotNull()).select("sha", "rep", "n", "top", "content", "b")
    results, level = [], 0
    while True:
        if level == 0:
            total = todo.groupBy("sha").agg(F.max("b").alias("b")).agg(F.sum("b")).first()[0] or 0
            ways = max(-(-2 * total // table_bytes), min(parts(spark), 12))
        bucket = (_digit(level) % ways).cast("int") if level == 0 else (F.col("bucket") * FANOUT + _digit(level) % FANOUT).cast("int")
        # Contents of one bucket, each counted once; hot texts were folded by partition and count once here.
        fill = todo.withColumn("bucket", bucket).groupBy("bucket", "sha").agg(F.max("b").alias("b"))
        fill = fill.groupBy("bucket").agg(F.sum("b").alias("b"), F.count("*").alias("texts"))
        over = fill.where((F.col("b") > table_bytes) & (F.col("texts") > 1)).select("bucket")
        n_over = over.count() if level < 7 else 0
        todo = todo.withColumn("bucket", bucket)
        fits = todo.join(over, "bucket", "left_anti") if n_over else todo
        width = int(ways if level == 0 else max(parts(spark), n_prev * FANOUT))
        placed = fits.withColumn("at", F.col("bucket") % width).repartitionById(width, F.col("at"))
        results.append(placed.select("sha", "rep", "n", "top", "content").mapInArrow(_merge_bucket, "rep string, keep_id long, group_size long"))
        if not n_over:
            break
        todo = spill(todo.join(over, "bucket", "left_semi"), f"dedup-l{level + 1}")
        n_prev, level = n_over, level + 1
    merged = results[0]
    for r in results[1:]:
        merged = merged.unionByName(r)
    joined = local.select("id", "sha", "rep").join(merged, "rep")
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_groups drops; its columns stay as they are.

    The rows that go are found by their ids, so that the texts are not shuffled again. A row without an id goes
    if its text occurs with an id, which is looked up by the text's digest.
    """
    groups = spill(exact_groups(df, id_col, text_col), "dedup-groups")
    gone = spill(groups.where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct(), "dedup-gone")
    kept = by_ids(df.where(F.col(id_col).isNotNull()), gone, id_col, "left_anti")
    named = groups.where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return kept.unionByName(df.where(F.col(id_col).isNull()).join(named, sha == F.col("_sha"), "left_anti"))


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
