"""Voice activity, runs, medians, merged turns and speaker runs on hand-made inputs and against plain loops."""

import random

from pyspark.sql import functions as F

from auralake.operators import islands
from auralake.streaming.live import VoiceActivity


def frames(spark, *files):
    return spark.createDataFrame([(f, i, float(p)) for f, ps in enumerate(files) for i, p in enumerate(ps)], "file long, i long, p double")


def test_voice_activity_cases(spark):
    got = islands.voice_activity(frames(spark, [0.0] * 5 + [0.9] * 10, [0.9] * 10 + [0.0] * 2, [0.9] * 10, [0.9] * 10 + [0.0] * 5 + [0.9] * 10, [0.9] * 3)).orderBy("file", "first").collect()
    assert [(r.file, r.start_ms, r.end_ms) for r in got] == [(0, 130, 480), (1, 0, 350), (2, 0, 320), (3, 0, 350), (3, 450, 800)]


def test_voice_activity_like_the_state_machine(spark):
    r = random.Random(3)
    files = [[r.choice((0.1, 0.2, 0.4, 0.6, 0.9)) if r.random() < 0.4 else 0.8 for _ in range(80)] for _ in range(30)]
    want = []
    for f, ps in enumerate(files):
        vad = VoiceActivity()
        want += [(f, *s) for i, p in enumerate(ps) if (s := vad.push(i, p))]
        if s := vad.end(len(ps)):
            want.append((f, *s))
    got = islands.voice_activity(frames(spark, *files)).collect()
    assert sorted((r.file, r.first, r.last) for r in got) == sorted(want)


def test_boundaries_and_regions(spark):
    levels = [1.0 if 20 <= i < 60 or 80 <= i < 83 else 0.0 for i in range(120)]
    got = islands.boundaries(spark.createDataFrame([(0, i, s) for i, s in enumerate(levels)], "file long, i long, s double")).collect()
    assert [(r.first, r.end) for r in got] == [(20, 60)]
    mask = spark.createDataFrame([(0, i, 10 <= i < 40 or i == 50) for i in range(60)], "file long, i long, m boolean")
    assert [(r.start_ms, r.end_ms) for r in islands.overlap_regions(mask, 50).collect()] == [(500, 2000)]


def test_median_fills_gaps_and_removes_blips(spark):
    bits = lambda hole, base: [(0, i, 1 - base if i == hole else base) for i in range(21)]
    for base in (0, 1):
        got = islands.median_filter(spark.createDataFrame(bits(10, base), "file long, i long, b int")).collect()
        assert {r.m for r in got} == {base}
    short = islands.median_filter(spark.createDataFrame(bits(10, 1)[8:13], "file long, i long, b int")).collect()
    assert [r.m for r in sorted(short, key=lambda r: r.i)] == [1, 1, 0, 1, 1]


def test_coalesce_turns(spark):
    rows = [(0, 0, 0, 2000, 0), (0, 1, 2300, 4000, 0), (0, 2, 4100, 6000, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, idx long, start_ms long, end_ms long, speaker long")
    got = islands.coalesce_turns(turns).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.speaker) for r in got] == [(0, 4000, 0), (4100, 6000, 1)]
    assert islands.coalesce_turns(turns, 0).count() == 3


def test_speaker_runs_keep_nulls_together_and_end_with_the_last_word(spark):
    rows = [(0, 0, "a", 0, 9, 1), (0, 1, "b", 1, 2, 1), (0, 2, "c", 3, 4, None), (0, 3, "d", 5, 6, None), (0, 4, "e", 7, 8, 1)]
    words = spark.createDataFrame(rows, "conv_id long, pos long, w string, start_ms long, end_ms long, speaker long")
    got = islands.segment_by_speaker(words).orderBy("id").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.speaker, r.text, r.n_words) for r in got] == [(0, 0, 2, 1, "a b", 2), (1, 3, 6, None, "c d", 2), (2, 7, 8, 1, "e", 1)]


def test_empty_tables(spark):
    none = frames(spark, [0.9]).where("false")
    assert islands.voice_activity(none).count() == 0
    assert islands.median_filter(none.select("file", "i", F.lit(1).alias("b"))).count() == 0
