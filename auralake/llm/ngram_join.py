"""Exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

All shingles have one global order, from rare to frequent. If two sets are similar, so that they share at least
t of the n shingles of either, then the first n - t + l shingles of both have l shingles in common, for every l.
Each document takes the l whose prefix has the least estimated cost; a pair must then share as many prefix
shingles as the lesser l of the two before it is verified.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, discard, join_counted, kept, parts, spill, table, take_over, text_bytes
from .components import components

WORDS, PERCENT = 4, 85
#: The frequency sketch has a counter for every four shingles of the corpus, within these bounds (powers of 2), in so many slabs.
LEAST_CELLS, MOST_CELLS, SLABS = 1 << 16, 1 << 25, 64
#: Shingles that a task holds before it counts them.
HELD = 1_500_000
#: Numbers of prefix matches that a document may ask for, and the cost of a verification in prefix entries.
MATCHES, VERIFY = (1, 2, 4, 8, 16), 40.0
#: Members of one part of a group, and how often pivots are compared before the rest of the groups is paired.
PART, TURNS = 256, 2


class _WordHashes(dict):
    """64-bit hashes of words; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@kept("ngram")
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingle_hashes(text: bytes, k: int = WORDS):
    """The sorted distinct 64-bit hashes of the text's k-word shingles: A-Z lower-cased, words between ASCII white space.
    A text of fewer words is one shingle; one without words has none."""
    import numpy as np

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    held = _hashes()
    h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    n, m = max(1, len(words) - k + 1), min(k, len(words))
    out = np.full(n, m, np.uint64)
    for i in range(m):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def similar(a, b, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    import numpy as np

    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def cell_of(hashes, cells: int):
    """The counters of hashes in a sketch of so many cells: the slab, then the place in it. A smaller sketch folds a larger one's slabs."""
    import numpy as np

    at = (hashes >> np.uint64(6)) & np.uint64(cells // SLABS - 1)
    return ((hashes & np.uint64(SLABS - 1)) * np.uint64(cells // SLABS) + at).astype(np.int64)


def prefix(hashes, level, percent: int = PERCENT):
    """The prefix of a set in the global order, its sketch levels and the number of matches it asks for: (hashes, levels, l).

    ``level``: the sketch's quantised frequencies, half-powers of 2, by cell. The cost of l is that of its prefix
    entries, each as many as the estimated frequency, and of verifying the candidates, of which each needs l entries.
    """
    import numpy as np

    n = len(hashes)
    lv = level[cell_of(hashes, len(level))]
    order = np.lexsort((hashes, lv))
    must = -(-percent * n // 100)
    seen = np.cumsum(2.0 ** (lv[order].astype(np.float64) / 2))
    least, best = None, 1
    for m in MATCHES:
        if m > must:
            break
        total = seen[n - must + m - 1]
        cost = total + VERIFY * total / m + 8.0 * (n - must + m)
        if least is None or cost < least:
            least, best = cost, m
    taken = order[: n - must + best]
    return hashes[taken], lv[taken], best


def _sets(k: int):
    """(id, text) rows to (id, n, digest) rows, and now and then the counts of the sketch's cells so far, slab by slab, in rows of their own."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        take_over("ngram")
        names, types = ["id", "n", "digest", "slab", "sketch"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        held, size = [], 0

        def counted():
            cells, n = np.unique(np.concatenate([cell_of(h, MOST_CELLS).astype(np.uint32) for h in held]), return_counts=True)
            cut = np.searchsorted(cells, np.arange(SLABS + 1, dtype=np.uint64) * (MOST_CELLS // SLABS))
            blobs = [_packed(cells[i:j] % np.uint32(MOST_CELLS // SLABS), n[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.nulls(SLABS, t) for t in types[:3]] + [pa.array(range(SLABS), types[3]), pa.array(blobs, types[4])], names=names)

        for batch in batches:
            ids, ns, digests = batch.column(0), [], []
            for text in text_bytes(batch.column(1)):
                hashes = shingle_hashes(text, k)
                ns.append(len(hashes))
                digests.append(hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None)
                held.append(hashes)
                size += len(hashes)
                if size > HELD:
                    yield counted()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, types[1]), pa.array(digests, types[2]), pa.nulls(len(ns), types[3]), pa.nulls(len(ns), types[4])], names=names)
        if size:
            yield counted()

    return run


def _packed(cells, n) -> bytes:
    """Sorted cells of a slab and their counts: the low bytes of steps and counts, then the high ones, and apart what is greater."""
    import numpy as np

    both = np.concatenate([np.diff(cells.astype(np.int64), prepend=0), n.astype(np.int64)])
    large = np.flatnonzero(both > 0xFFFF)
    planes = np.where(both > 0xFFFF, 0, both).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zlib.compress(np.int64([len(cells), len(large)]).tobytes() + large.tobytes() + both[large].tobytes() + planes, 1)


def _unpacked(blob: bytes):
    import numpy as np

    raw = zlib.decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    low, high = np.frombuffer(raw, np.uint8, offset=16 + 16 * m).reshape(2, -1).astype(np.int64)
    both = low | high << 8
    both[np.frombuffer(raw, np.int64, m, 16)] = np.frombuffer(raw, np.int64, m, 16 + 8 * m)
    return np.cumsum(both[:n]), both[n:]


def _sum_slabs(cells: int):
    """(slab, sketch) rows to (slab, levels) rows: the counts of all rows of a slab, folded to a sketch of so many cells, in half-powers of 2."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        take_over("ngram")
        total: dict[int, object] = {}
        for batch in batches:
            for slab, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = _unpacked(blob.as_py())
                if slab not in total:
                    total[slab] = np.zeros(cells // SLABS, np.int64)
                np.add.at(total[slab], at % (cells // SLABS), n)
        for slab, x in total.items():
            level = np.rint(2 * np.log2(np.maximum(x, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slab", "levels"])

    return run


def _levels(sketches: DataFrame, shingles: int):
    """The frequencies of all sketches together, in half-powers of 2: a byte a cell for the driver, MOST_CELLS of them at most. Slabs are summed side by side."""
    import numpy as np

    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(max(shingles, 4) / 4))))
    slabs = sketches.repartition(SLABS, "slab").mapInArrow(_sum_slabs(cells), "slab int, levels binary").collect()
    level = np.zeros(cells, np.uint8)
    for r in slabs:
        level[r.slab * (cells // SLABS) : (r.slab + 1) * (cells // SLABS)] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    return level


def _prefix_rows(sent, k: int, percent: int, crowd: float):
    """(node, text) rows to (token, node, n, l, pos, ways) rows. A token that the sketch has above ``crowd`` is hot and
    to be dealt in so many ways; the sketch counts too much at times, but never too little, so that all others (0) have no more nodes than that."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        take_over("ngram")
        level, names = sent.value, ["token", "node", "n", "l", "pos", "ways"]
        for batch in batches:
            held, size = [], 0
            for node, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                hashes = shingle_hashes(text, k)
                if len(hashes):
                    p, lv, m = prefix(hashes, level, percent)
                    c = len(p)
                    many = 2.0 ** (lv.astype(np.float64) / 2)
                    ways = np.where(many * 1.2 > crowd, np.minimum(np.ceil(many / PART), 1 << 20), 0).astype(np.int32)  # levels are rounded, by a fifth at most
                    held.append((p.view(np.int64), np.full(c, node, np.int64), np.full(c, len(hashes), np.int32), np.full(c, m, np.int32), np.arange(c, dtype=np.int32), ways))
                    size += c
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)

    return run


def _dealt(small: DataFrame, ways) -> DataFrame:
    """A table of one row a key, repeated for each of the ways in which the other table deals out its rows of that key."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1)))


def _salt(ways):
    return F.pmod(F.xxhash64("node"), F.greatest(ways, F.lit(1)).cast("long")).cast("int")


def _shared(index: DataFrame) -> DataFrame:
    """The prefix tokens that several nodes have, those with the same nodes folded into one group:
    (sig, node, n, l, pos, w, ways), where w counts the tokens, pos is the first one's place and ways says in how many parts the group is dealt out.

    Tokens that are not hot have a bounded number of nodes and need one shuffle; hot ones are summed before
    they are shuffled and joined back, in as many parts as they need. The signature is a hash of the nodes; if two
    groups' were equal, candidates would be added and none lost.
    """
    mark = [F.min("node"), F.max("node"), F.bit_xor(F.xxhash64("node")), F.sum(F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.lit(1 << 31))), F.count("*")]
    names = ["lo", "hi", "s1", "s2", "c"]
    w = Window.partitionBy("token")
    cold = index.where("ways = 0").select("token", "node", "n", "l", "pos", *[m.over(w).alias(k) for m, k in zip(mark, names, strict=True)]).where("lo <> hi")
    hot = index.where("ways > 0").withColumn("salt", _salt(F.col("ways")))
    sums = hot.groupBy("token").agg(F.max("ways").alias("ways"), *[m.alias(k) for m, k in zip(mark, names, strict=True)]).where("lo <> hi")
    hot = hot.drop("ways").join(_dealt(sums, F.col("ways")), ["token", "salt"]).select(*cold.columns)
    return cold.unionByName(hot).groupBy(F.xxhash64("s1", "s2", "c").alias("sig"), "node").agg(
        F.min("n").alias("n"), F.min("l").alias("l"), F.min("pos").alias("pos"), F.count("*").alias("w"), F.ceil(F.max("c") / PART).cast("int").alias("ways")
    )


def _open(groups: DataFrame) -> DataFrame:
    """The groups whose members are in several components c."""
    several = groups.groupBy("sig").agg(F.max("ways").alias("_ways"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi")
    several = _dealt(several.select("sig", "_ways"), F.col("_ways")).drop("_ways")
    return groups.withColumn("salt", _salt(F.col("ways"))).join(several, ["sig", "salt"]).drop("salt")


def _pivots(groups: DataFrame, turn: int) -> DataFrame:
    """Two members of every group, dealt out: first the one whose first token is the rarest for it, as the text has of which others are edited copies."""
    one = [F.col("pos").cast("long"), F.xxhash64(F.col("c"), F.lit(turn))][turn > 0]
    two = [F.col("node"), F.xxhash64(F.col("node"), F.lit(turn))][turn > 0]
    pick = [F.min(F.struct(o.alias("o"), "node", "n", "pos", "c")) for o in (one, two)]
    found = groups.groupBy("sig").agg(F.max("ways").alias("_ways"), F.array_distinct(F.array(*[p.dropFields("o") for p in pick])).alias("ps"))
    found = found.select("sig", "_ways", F.explode("ps").alias("p")).select(
        "sig", "_ways", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"), F.col("p.c").alias("pc")
    )
    return _dealt(found, F.col("_ways")).drop("_ways")


def enough(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that have as many prefix shingles in common as the lesser l of the two asks for."""
    mine = shared.select(F.col("node").alias("a"), "sig", "l", "w")
    theirs = shared.select(F.col("node").alias("b"), "sig", F.col("l").alias("pl"))
    return (
        pairs.join(mine, "a").join(theirs, ["b", "sig"]).groupBy("a", "b")
        .agg(F.sum("w").alias("m"), F.min("l").alias("l"), F.min("pl").alias("pl"), F.max("ways").alias("ways"))
        .where(F.col("m") >= F.least("l", "pl")).select("a", "b", "ways")
    )


def _compare(k: int, percent: int):
    """(a, part, b, text) rows, sorted so that a's own text leads its part, to the links (a, b)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("ngram")
        key, own = None, None
        for batch in batches:
            found = []
            for a, part, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3)), strict=True):
                hashes = shingle_hashes(text, k)
                if a == b:
                    key, own = (a, part), hashes
                elif key == (a, part) and similar(own, hashes, percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, ways) that are similar. The members of a are compared in parts, so that a hot one is split.
    Only the texts of nodes that are in a pair are moved."""
    members = pairs.select("a", F.pmod(F.xxhash64("b"), F.greatest("ways", F.lit(1)).cast("long")).cast("int").alias("part"), "b")
    rows = members.unionByName(members.select("a", "part").distinct().withColumn("b", F.col("a")))
    sought = by_ids(texts, rows.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    # Merged by shuffle at every size, as it must be at a large one.
    rows = rows.join(sought.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "part", "b", "text")
    dealt = rows.repartition(max(parts(rows.sparkSession), 12), "a", "part").sortWithinPartitions("a", "part", (F.col("a") != F.col("b")).cast("int"))
    return dealt.mapInArrow(_compare(k, percent), "a long, b long")


def _digests(k: int):
    """(id, text) rows to (id, n, digest, text) rows."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("ngram")
        for batch in batches:
            found = [shingle_hashes(t, k) for t in text_bytes(batch.column(1))]
            digests = [hashlib.md5(h.tobytes()).digest() if len(h) else None for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(digests, pa.binary()), batch.column(1)], names=["id", "n", "digest", "text"])

    return run


def _nodes(own: DataFrame, sets: DataFrame, k: int):
    """The distinct sets as nodes: rows by node (id, n, node: null without shingles), nodes (node, first: the least id, c: how many rows), a text of each.

    Where every row has an id of its own, a node is named by the least id of its rows; else its rows are numbered.
    """
    if sets.where("id is null").limit(1).count() or sets.groupBy("id").count().where("count > 1").limit(1).count():
        rows = spill(own.mapInArrow(_digests(k), "id long, n long, digest binary, text string").withColumn("rid", F.monotonically_increasing_id()), "ngram-rows")
        reps = spill(rows.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("node"), F.min("id").alias("first"), F.count("*").alias("c")), "ngram-nodes")
        texts = by_ids(rows.select(F.col("rid").alias("node"), "text"), reps.select("node"), "node", "left_semi")
    else:
        rows, texts = sets, None
        reps = spill(rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.min("id").alias("first"), F.count("*").alias("c")), "ngram-nodes")
    named = join_counted(rows.where("digest is not null").select("id", "n", "digest"), reps.select("digest", "node", "c"), "digest").select("id", "n", "node")
    named = spill(named.unionByName(rows.where("digest is null").select("id", "n", F.lit(None).cast("long").alias("node"))), "ngram-named")
    if texts is None:
        texts = by_ids(own, named.where("node is null or id <> node").select("id"), "node", "left_anti")
    return named, reps.select("node", "first", "c"), texts


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the least id that links reach, its own included).

    Two rows link if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles. A text without
    words (null, empty) has no shingles and links with nothing; a text of fewer than k words is one shingle. Rows
    that repeat an id are rows of their own, each linked by its own set: a node is a set, not an id. A row with a
    null id keeps a null component_id unless links reach an id, which then names it. Columns other than the two
    named are not read.

    1. One pass makes each row's set digest and a frequency sketch, which has a counter for every four shingles.
       Equal sets become one node: groups of copies are never compared.
    2. A second pass yields the nodes' prefix shingles in the sketch's order (see ``prefix``). Prefix
       shingles that only one node has are left out.
    3. Shingles that the same nodes have are one group. In every group, all nodes are candidates of two pivots only,
       then of two others: links found so join most of a group of near copies. Only nodes of a group that are
       still in different components are paired with each other. Nodes in one component need no more links, so none
       that matters is lost.
    4. A candidate is verified if its places in the global order allow for the similarity and the two share as many
       prefix shingles as the lesser l asks for.
    Similarity is taken on 64-bit shingle hashes of both whole texts.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    made = spill(own.mapInArrow(_sets(k), "id long, n long, digest binary, slab int, sketch binary"), "ngram-sets")
    sets = made.where("slab is null").select("id", "n", "digest")
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast(_levels(made.where("slab is not null").select("slab", "sketch"), shingles))
    crowd = 1000.0 + 2.0 * shingles / len(sent.value)
    named, reps, nodes = _nodes(own, sets, k)
    index = spill(nodes.mapInArrow(_prefix_rows(sent, k, percent, crowd), "token long, node long, n int, l int, pos int, ways int"), "ngram-index")
    shared = spill(_shared(index), "ngram-shared")
    discard(index, made)
    sent.destroy()

    # Of a pair's first common prefix token, all tokens before it are in one of the two only: no more can be shared
    # than what is left from there on. A similar pair passes this in the group of that token, so it may be asked in all.
    most = F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos"))
    fits = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (most * (100 + percent) >= (F.col("n") + F.col("pn")) * percent)
    links, tried, labels, groups, held = None, None, None, shared.withColumn("c", F.col("node")), []
    for turn in range(TURNS + 1):
        if turn < TURNS:
            pairs = groups.withColumn("salt", _salt(F.col("ways"))).join(_pivots(groups, turn), ["sig", "salt"])
            pairs = pairs.where((F.col("c") != F.col("pc")) & fits)
        else:
            # Lengths of similar sets are in the same or the next class: members of other classes don't meet.
            step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
            sized = groups.withColumn("size", step)
            other = sized.select("sig", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("pos").alias("ppos"), F.explode(F.array("size", F.col("size") + 1, F.col("size") - 1)).alias("size"))
            pairs = sized.join(other, ["sig", "size"]).where((F.col("node") < F.col("pivot")) & (F.col("c") != F.col("pc")) & fits)
        # The pivot of the larger group comes first: its text is read once for each part of its candidates.
        sides = pairs.groupBy(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")).agg(
            F.max(F.when(F.col("pivot") < F.col("node"), F.col("ways")).otherwise(0)).alias("xw"), F.max(F.when(F.col("pivot") > F.col("node"), F.col("ways")).otherwise(0)).alias("yw")
        )
        sides = sides if tried is None else sides.join(tried, ["x", "y"], "left_anti")
        sides = spill(sides, "ngram-pairs")
        first = F.col("xw") >= F.col("yw")
        fresh = spill(enough(sides.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.greatest("xw", "yw").alias("ways")), shared), "ngram-fresh")
        found = spill(verified(fresh, nodes, k, percent), "ngram-links")
        tried = sides.select("x", "y") if tried is None else tried.unionByName(sides.select("x", "y"))
        links = found if links is None else links.unionByName(found)
        held += [sides, found]
        discard(fresh, labels)
        labels = components(links)
        if turn < TURNS:
            groups = spill(_open(_labelled(shared, labels)), "ngram-open")
            held.append(groups)
    reps = spill(_labelled(reps.withColumnRenamed("c", "rows"), labels), "ngram-named")
    least = reps.groupBy("c").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    reps = join_counted(reps, least, "c", "nodes").select("node", "component_id", "rows")
    discard(shared, labels, *held)
    joined = join_counted(named.where("node is not null"), reps, "node", "rows").select("id", "n", "component_id")
    joined = joined.unionByName(named.where("node is null").select("id", "n", F.col("id").alias("component_id")))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component c of their node; a node without links is its own."""
    return rows.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near copies: the one whose id names the component. Rows without an id stay,
    as do the columns. Documents without words have no copies and stay too. Rows that repeat an id are one document, which
    goes if all of them are copies of others."""
    found = join_components(docs, id_col, text_col, k, percent).where(F.col(id_col).isNotNull())
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max("component_id").alias("_c")).where("_gone <> _c").select("_gone")
    return by_ids(docs, spill(gone, "ngram-gone"), id_col, "left_anti")


def op10_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""
