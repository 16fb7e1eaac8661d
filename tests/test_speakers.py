"""Interval joins, votes, overlaps, packing, clustering and frames."""

import numpy as np
from pyspark.sql import functions as F

from auralake.operators import cluster, frames, intervals, packing

TURN = "conv_id long, idx long, start_ms long, end_ms long, speaker long"


def test_best_speaker(spark):
    words = spark.createDataFrame([(0, 0, 1000, 2000), (0, 1, 6000, 9000), (1, 0, 12000, 13000), (1, 1, 5100, 5500), (1, 2, 5400, 5800)], "conv_id long, pos long, start_ms long, end_ms long")
    turns = spark.createDataFrame([(0, 0, 0, 5000, 0), (0, 1, 5000, 10000, 1), (1, 0, 0, 5000, 0), (1, 1, 20000, 25000, 1)], TURN)
    for bucket in (1000, 30_000):
        got = intervals.best_speaker(words, turns, bucket_ms=bucket).orderBy("conv_id", "pos").collect()
        assert [r.speaker for r in got] == [0, 1, None, 0, None]


def test_vote_takes_the_least_of_a_tie(spark):
    rows = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (0, 1), (1, None), (2, None), (2, 3)], "g long, speaker long")
    assert {(r.g, r.speaker, r.votes) for r in intervals.vote(rows, ["g"]).collect()} == {(0, 1, 2), (1, None, 0), (2, 3, 1)}


def mark(spark, speaker, turns, regions):
    segs = spark.createDataFrame([(0, 0, 0, 2000, speaker)], "conv_id long, id long, start_ms long, end_ms long, speaker long")
    t = spark.createDataFrame([(0, i, *x) for i, x in enumerate(turns)], TURN)
    r = spark.createDataFrame([(0, *x) for x in regions], "conv_id long, start_ms long, end_ms long")
    return intervals.mark_overlaps(segs, r, t).first()


def test_overlaps(spark):
    two = [(0, 2000, 0), (500, 1500, 1)]
    got = mark(spark, 1, two, [(500, 1500)])
    assert got.overlap and got.speakers == [1, 0]
    assert not mark(spark, 1, two, []).overlap
    assert mark(spark, 1, two[:1], [(500, 1500)]).speakers == []
    assert mark(spark, None, two, [(500, 1500)]).speakers == [0, 1]
    assert mark(spark, 2, [(0, 2000, 0), (0, 1900, 1), (0, 1000, 2)], [(0, 2000)]).speakers == [2, 1, 0]


def test_blocks(spark):
    def blocks(speech, total):
        s = spark.createDataFrame([(0, *x) for x in speech], "conv_id long, start_ms long, end_ms long")
        got = packing.pack_blocks(s, spark.createDataFrame([(0, total)], "conv_id long, total_ms long"), 28).orderBy("block").collect()
        return [(r.start_ms, r.end_ms) for r in got]

    assert blocks([(0, 10), (12, 20), (35, 50)], 55) == [(0, 20), (35, 50)]
    assert blocks([(0, 60)], 60) == [(0, 28), (28, 56), (56, 60)]
    assert blocks([], 40) == [(0, 28), (28, 40)] or blocks([], 40) == [(0, 40)]


def test_windows_and_concat(spark):
    w = packing.sliding_windows(spark.createDataFrame([(0, 12), (1, 0)], "k long, n long"), 10, 5, "n", "k").orderBy("first").collect()
    assert [(r.first, r.real) for r in w] == [(0, 10), (5, 7), (10, 2)]
    rows = [(0, 0, 0, 0, 0, 5, " a ", "es", "x"), (0, 1, 0, 100, 1, 2, " ", "en", "y")]
    got = packing.concat_blocks(spark.createDataFrame(rows, "conv_id long, block long, seg long, block_start_ms long, start_ms long, end_ms long, text string, language string, device string")).first()
    assert (got.n_segments, got.text, got.language, got.device, got.last_ms) == (1, "a", "es", "y", 5)


def test_clusters():
    def labels(x, k=None, thr=0.55):
        x = np.array(x, float)
        return cluster.cut(len(x), cluster.average_linkage(x), k, thr)

    assert labels([[1, 0, 0], [0.98, 0.05, 0], [0, 0, 1], [0.02, 0, 0.99]], thr=0.5) == [0, 0, 1, 1]
    assert labels([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]], 1) == [0, 0, 0, 0]
    assert labels([[1, 0, 0], [0.99, 0.1, 0], [0.6, 0.8, 0], [0.62, 0.78, 0]], thr=0.9) == [0, 0, 1, 1]
    assert labels([[1, 0], [0.99, 0.05], [0.98, 0.03]]) == [0, 0, 0]


def test_linkage_holds_no_table_of_distances():
    import tracemalloc

    def plain(x):
        """Mean distances of all clusters, taken anew for each step."""
        unit = [v / np.linalg.norm(v) if np.linalg.norm(v) >= 1e-8 else v * 0 for v in x]
        groups, heights = [[i] for i in range(len(x))], []
        while len(groups) > 4:
            h, a, b = min((float(np.mean([1 - unit[i] @ unit[j] for i in p for j in q])), n, m) for m, q in enumerate(groups) for n, p in enumerate(groups[:m]))
            heights.append(h)
            groups[a] += groups.pop(b)
        return {frozenset(g) for g in groups}, heights

    r = np.random.default_rng(5)
    for zero in (False, True) * 4:
        x = r.normal(size=(24, 5))
        x[7] = 3 * x[2]
        x[9] *= not zero
        steps = cluster.average_linkage(x)
        labels, (groups, heights) = cluster.cut(24, steps, 4), plain(x)
        assert {frozenset(i for i in range(24) if labels[i] == k) for k in set(labels)} == groups
        assert np.allclose([s[2] for s in steps[:20]], heights, atol=1e-9) and len(steps) == 23
    # Distances that differ by rounding alone, and many copies.
    assert len(cluster.average_linkage(np.eye(40)[np.arange(400) % 40] * np.linspace(0.1, 3, 400)[:, None])) == 399
    x = r.normal(size=(1500, 8))
    tracemalloc.start()
    assert len(cluster.average_linkage(x)) == 1499
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # one table of distances is 18 MB


def test_nearest_pairs_are_those_of_all_pairs(spark):
    from pyspark.sql import Window

    r = np.random.default_rng(3)
    rows = [(f"f{i % 2}", 7 * i % 601, [float(v) for v in np.float32(r.normal(size=6))]) for i in range(300)]
    rows += [("copies", i, [1.0, 2.0, 0.5]) for i in range(120)] + [("copies", 200 + i, [1.0 + i, 2.0, -0.5]) for i in range(30)]
    rows += [("odd", 0, [0.0, 0.0]), ("odd", 1, None), ("odd", 2, [1.0, 0.0]), ("odd", 3, [float("nan"), 1.0]), ("odd", 4, [1.0, 2.0, 3.0]), ("one", 0, [1.0]), (None, 0, [1.0]), (None, 1, [1.0])]
    rows += [("half", 0, [1.0, 0.0]), ("half", 1, [0.5, 0.8660258]), ("half", 2, [0.5, -0.8660258]), ("none", 0, None), ("none", 1, None)]
    v = spark.createDataFrame(rows, "file string, i long, x array<double>")
    w = Window.partitionBy("file").orderBy(F.col("d").asc_nulls_last(), "i", "j")
    every = cluster.pair_distances(v).withColumn("d", F.round("d", 6)).withColumn("r", F.row_number().over(w)).where("r <= 9").drop("r")
    say = lambda df: sorted((x.file, x.i, x.j, str(x.d)) for x in df.collect())
    want = say(every)
    assert len(want) == 9 * 4 + 3 + 1 and say(cluster.nearest_pairs(v, 9)) == want and say(cluster.nearest_pairs(v, 9, block=16)) == want
    assert cluster._rounded(np.array([0.0000005, 1.0000015, 0.1234565, 2.5e-7, np.nan]), 6)[:4].tolist() == [1e-6, 1.000002, 0.123457, 0.0]


def test_pairs_query_makes_no_row_for_each_pair(spark):
    from auralake.plans import catalogue

    plan = catalogue.cosine_pairs_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "zipwith" not in plan.lower()


def test_cluster_and_merge_count_on_tables(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [0.9, 0.1]), ("b", 0, [0.0, 0.0])], "file string, i long, x array<double>")
    assert {(r.file, r.i, r.label) for r in cluster.cluster(v, 2).collect()} == {("a", 0, 0), ("a", 1, 1), ("a", 2, 0), ("b", 0, 0)}
    steps = spark.createDataFrame([(0, i, h) for i, h in enumerate((0.1, 0.2, 0.7))] + [(1, i, h) for i, h in enumerate((0.1, 0.2, 0.25))] + [(2, 0, 0.9)], "file long, step long, height double")
    assert {(r.file, r.merges) for r in cluster.merge_count(steps).collect()} == {(0, 2), (1, 3), (2, 0)}


def test_powerset(spark):
    rows = [(0, f, [1.0 if c == f else 0.0 for c in range(7)]) for f in range(7)] + [(1, 0, [float("nan")] * 7), (1, 1, [0.0, 0.8, 0.7, 0.0, 0.9, 0.0, 0.0])]
    got = {(r.file, r.frame): (r.s0, r.s1, r.s2) for r in frames.powerset(spark.createDataFrame(rows, "file long, frame long, x array<double>")).collect()}
    assert [got[0, f] for f in range(7)] == list(frames.POWERSET) and got[1, 0] == (0, 0, 0) and got[1, 1] == (1, 1, 0)


def test_overlap_add(spark):
    rows = [(0, 0, 0, 3), (0, 0, 0, 0), (1, 0, 0, 2), (1, 0, 0, 2), (2, 0, 5, 2), (2, 100, 4, 2)]
    got = {r.file: r for r in frames.overlap_add(spark.createDataFrame(rows, "file long, offset_ms long, frame long, active long"), 100.0).collect()}
    assert (got[0].speakers, got[0].overlap) == (2, False) and (got[1].speakers, got[1].overlap) == (2, True)
    assert got[2].weight == 2 and got[2].g == 5
    full = frames.full_grid(frames.overlap_add(spark.createDataFrame(rows[:1], "file long, offset_ms long, frame long, active long"), 100.0), spark.createDataFrame([(0, 3)], "file long, n_grid long"))
    assert full.agg(F.sum("weight")).first()[0] == 1 and full.count() == 3
