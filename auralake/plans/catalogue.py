"""All registered queries of the speech-transcript engine and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch, cluster, frames, intervals, islands, packing, render, tokens, trace
from ..sources import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _words(spark, d):
    return A.words(A.read(spark, d, "conversations"))


def _frames(spark, d):
    return A.frames(A.read(spark, d, "events"))


_WORD_TURNS = f"WITH {A.WORDS}, {A.turns_sql()}"


@query("""
WITH k AS (SELECT user_id AS file, event_type AS provider, floor(value * 1000)::BIGINT AS us FROM events),
g AS (SELECT file, provider, count(*) AS nodes, sum(us)::BIGINT AS us FROM k GROUP BY ALL)
SELECT file, provider, nodes, round(100.0::DOUBLE * nodes / greatest(sum(nodes) OVER w, 1)::DOUBLE, 6) AS pct_nodes, round(us::DOUBLE / 1000, 6) AS ms,
  round(100.0::DOUBLE * us / greatest(sum(us) OVER w, 1)::DOUBLE, 6) AS pct_time, row_number() OVER (PARTITION BY file ORDER BY us DESC, provider) AS place
FROM g WINDOW w AS (PARTITION BY file)""")
def profile_provider_share(spark: SparkSession, d: str) -> DataFrame:
    """Kernels and time by provider."""
    return trace.provider_share(A.kernel_events(A.read(spark, d, "events")))


@query("""
SELECT event_type, count(*) AS n, count(k) AS typed, sum(coalesce(k, 0))::BIGINT AS total
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def profile_json_events(spark: SparkSession, d: str) -> DataFrame:
    """typed access to a JSON path; what has another type counts 0."""
    rows = A.read(spark, d, "events").select("event_type", trace.whole_number(F.col("props"), "$.k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("typed"), F.sum(F.coalesce("k", F.lit(0))).alias("total"))


@query(f"""
WITH {A.FRAMES},
a AS (SELECT file, i, p, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING) AS g, count(*) OVER (PARTITION BY file) AS n FROM frames),
b AS (SELECT file, g, max(n) AS n, min(i) AS v, min(CASE WHEN p < 0.35 THEN i END) AS s0, max(CASE WHEN p < 0.35 THEN i END) AS s1 FROM a WHERE g > 0 GROUP BY file, g),
c AS (SELECT *, coalesce(s1 - s0 >= 4, false) AS closes FROM b),
e0 AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM c),
e AS (SELECT file, isl, max(n) AS n, min(v) AS first, bool_or(closes) AS closed, nullif(max_by(coalesce(s0, -1), g), -1) AS s0 FROM e0 GROUP BY file, isl)
SELECT file, first, coalesce(s0, n) AS last, closed, greatest(first * 32 - 30, 0) AS start_ms,
  CASE WHEN closed THEN coalesce(s0, n) * 32 + 30 ELSE least(coalesce(s0, n) * 32 + 30, n * 32) END AS end_ms
FROM e WHERE coalesce(s0, n) - first >= 8""")
def vad_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Voice activity with two thresholds and a silence timer."""
    return islands.voice_activity(_frames(spark, d))


@query(f"""
WITH {A.FRAMES}, l AS (SELECT file, i, round(p * 2, 4) AS s FROM frames),
h AS (SELECT file, i, coalesce(last_value(CASE WHEN s >= 1 THEN true WHEN s < 0.5 THEN false END IGNORE NULLS) OVER (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS on_ FROM l),
r AS (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS t FROM h WHERE on_)
SELECT file, min(i) AS first, max(i) + 1 AS "end" FROM r GROUP BY file, t HAVING count(*) >= 10""")
def hysteresis_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Runs between two levels."""
    return islands.boundaries(_frames(spark, d).select("file", "i", F.round(F.col("p") * 2, 4).alias("s")))


@query(f"""
WITH {A.FRAMES}, r AS (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS t FROM frames WHERE p >= 0.5)
SELECT file, min(i) * 50 AS start_ms, (max(i) + 1) * 50 AS end_ms FROM r GROUP BY file, t HAVING count(*) * 50 >= 100""")
def overlap_regions(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of a mask."""
    return islands.overlap_regions(_frames(spark, d).select("file", "i", (F.col("p") >= 0.5).alias("m")), 50)


@query(f"""
WITH {A.FRAMES}, b AS (SELECT file, i, (p >= 0.3)::INT AS b FROM frames)
SELECT file, i, b, CASE WHEN count(*) OVER (PARTITION BY file) < 11 THEN b
  ELSE list_sort(list(b) OVER w)[len(list(b) OVER w) // 2 + 1] END AS m
FROM b WINDOW w AS (PARTITION BY file ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    """Centred moving median of bits."""
    return islands.median_filter(_frames(spark, d).select("file", "i", (F.col("p") >= 0.3).cast("int").alias("b")))


_SPEECH_TURNS = A.turns_sql(0, 0, "speech")


@query(f"""
WITH {A.WORDS}, {A.turns_sql()}, t AS (SELECT conv_id, idx, start_ms, end_ms, speaker % 2 AS speaker FROM turns),
r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY start_ms, idx) AS run FROM (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR lag(idx) OVER w IS NULL THEN 1 ELSE 0 END AS c
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, idx))),
m AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY conv_id, run ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 500 THEN 0 ELSE 1 END AS n FROM r),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, run ORDER BY start_ms, idx) AS isl FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY run, isl) - 1 AS idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, speaker FROM i GROUP BY conv_id, run, isl, speaker""")
def turn_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Merges turns of one speaker that are close."""
    rows = A.turns(_words(spark, d)).withColumn("speaker", F.col("speaker") % 2)
    return islands.coalesce_turns(rows)


@query(f"""
WITH RECURSIVE {A.WORDS}, {_SPEECH_TURNS}, files AS (SELECT conv_id, max(end_ms) AS total_ms FROM words GROUP BY conv_id),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms) AS r, start_ms AS a, end_ms AS b FROM speech),
t AS (SELECT conv_id, r, a AS bs, b AS be, 0 AS blk FROM o WHERE r = 1 UNION ALL
  SELECT o.conv_id, o.r, CASE WHEN o.b - t.bs <= 28000 THEN t.bs ELSE o.a END, o.b, CASE WHEN o.b - t.bs <= 28000 THEN t.blk ELSE t.blk + 1 END FROM t JOIN o ON o.conv_id = t.conv_id AND o.r = t.r + 1),
g AS (SELECT conv_id, min(bs) AS a, max_by(be, r) AS b FROM t GROUP BY conv_id, blk UNION ALL SELECT conv_id, 0, total_ms FROM files WHERE conv_id NOT IN (SELECT conv_id FROM speech)),
c AS (SELECT conv_id, unnest(generate_series(a, greatest(a, b - 1), 28000)) AS start_ms, b FROM g)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, b) - 1 AS block, start_ms, least(start_ms + 28000, b) AS end_ms FROM c""")
def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing of speech into blocks of 28 s."""
    words = _words(spark, d)
    return packing.pack_blocks(A.turns(words, 0, 0), words.groupBy("conv_id").agg(F.max("end_ms").alias("total_ms")))


_BEST = """best AS (SELECT w.conv_id, w.pos, w.turn, w.w, w.start_ms, w.end_ms, t.speaker FROM words w LEFT JOIN (
  SELECT w.conv_id, w.pos, t.speaker, row_number() OVER (PARTITION BY w.conv_id, w.pos ORDER BY greatest(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms), 0) DESC,
    greatest(t.start_ms - (w.start_ms + w.end_ms) / 2, (w.start_ms + w.end_ms) / 2 - t.end_ms, 0), t.idx) AS r
  FROM words w JOIN turns t ON w.conv_id = t.conv_id AND ((w.start_ms < t.end_ms AND w.end_ms > t.start_ms)
    OR greatest(t.start_ms - (w.start_ms + w.end_ms) / 2, (w.start_ms + w.end_ms) / 2 - t.end_ms) <= 500)) t ON t.conv_id = w.conv_id AND t.pos = w.pos AND t.r = 1)"""


def _spoken(spark, d):
    words = _words(spark, d)
    return intervals.best_speaker(words, A.turns(words))


@query(f"{_WORD_TURNS}, {_BEST} SELECT conv_id, pos, start_ms, end_ms, speaker FROM best")
def best_overlap_speaker(spark: SparkSession, d: str) -> DataFrame:
    """The turn with the longest overlap, else the nearest within half a second."""
    return _spoken(spark, d).select("conv_id", "pos", "start_ms", "end_ms", "speaker")


@query(f"""{_WORD_TURNS}, {_BEST},
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS id FROM (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS n FROM best WINDOW w AS (PARTITION BY conv_id ORDER BY pos)))
SELECT conv_id, id::BIGINT AS id, min_by(start_ms, pos) AS start_ms, max_by(end_ms, pos) AS end_ms, speaker, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM s GROUP BY conv_id, id, speaker""")
def segment_by_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words of one speaker."""
    return islands.segment_by_speaker(_spoken(spark, d))


@query(f"""{_WORD_TURNS}, {_BEST}, c AS (SELECT conv_id, turn, speaker, count(speaker) AS n FROM best GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, speaker NULLS LAST) AS r FROM c)
SELECT conv_id, turn, CASE WHEN n > 0 THEN speaker END AS speaker, n AS votes FROM r WHERE r = 1""")
def assign_speakers_vote(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's speaker by its words' majority."""
    return intervals.vote(_spoken(spark, d), ["conv_id", "turn"])


_SEGMENTS = "segs AS (SELECT conv_id, turn AS id, start_ms, end_ms, speaker, text FROM spans)"


@query(f"""WITH {A.WORDS}, {A.SPANS}, {A.turns_sql()}, {A.REGIONS}, {_SEGMENTS},
hit AS (SELECT s.conv_id, s.id FROM segs s JOIN regions r ON s.conv_id = r.conv_id AND least(s.end_ms, r.end_ms) > greatest(s.start_ms, r.start_ms)
  GROUP BY s.conv_id, s.id, s.start_ms, s.end_ms HAVING 10 * max(least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) >= greatest(1000, s.end_ms - s.start_ms)),
who AS (SELECT s.conv_id, s.id, t.speaker AS who, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS o FROM segs s JOIN turns t ON s.conv_id = t.conv_id AND least(s.end_ms, t.end_ms) > greatest(s.start_ms, t.start_ms) GROUP BY ALL),
l AS (SELECT conv_id, id, list(who ORDER BY o DESC, who) AS f FROM who GROUP BY conv_id, id HAVING count(*) >= 2),
m AS (SELECT s.*, l.f, coalesce(list_position(l.f, s.speaker), 0) AS pl FROM segs s LEFT JOIN (l JOIN hit USING (conv_id, id)) ON l.conv_id = s.conv_id AND l.id = s.id)
SELECT conv_id, id, start_ms, end_ms, speaker, f IS NOT NULL AS overlap, CASE WHEN f IS NULL THEN '' WHEN pl > 1
  THEN array_to_string([CASE WHEN i = 1 THEN f[pl] WHEN i = pl THEN f[1] ELSE f[i] END FOR i IN range(1, len(f) + 1)], ',') ELSE array_to_string(f, ',') END AS speakers FROM m""")
def mark_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Segments in which several speakers are heard."""
    words = _words(spark, d)
    turns, segs = A.turns(words), A.spans(words).withColumnRenamed("turn", "id")
    found = intervals.mark_overlaps(segs, A.regions(turns), turns)
    return found.select("conv_id", "id", "start_ms", "end_ms", "speaker", "overlap", F.array_join(F.col("speakers").cast("array<string>"), ",").alias("speakers"))


_WINDOWS = "win AS (SELECT file, w * 5000 AS offset_ms, i - w * 50 AS frame, (p >= 0.1)::INT + (p >= 0.3)::INT + (p >= 0.6)::INT AS active FROM frames JOIN range(0, 1000) t(w) ON i >= w * 50 AND i < w * 50 + 100)"


@query(f"""WITH {A.FRAMES}, {_WINDOWS},
g AS (SELECT file, round((offset_ms + frame * 100.0) / 100.0)::BIGINT AS g, sum(active)::BIGINT AS active, count(*) AS weight FROM win GROUP BY ALL)
SELECT file, g, active, weight, round(active / weight, 6) AS mean, floor(active / weight + 0.5)::BIGINT AS speakers, active / weight >= 1.75 AS overlap FROM g""")
def overlap_add_grid(spark: SparkSession, d: str) -> DataFrame:
    """Windows of ten seconds, every five, put on one grid."""
    rows = _frames(spark, d)
    active = (F.col("p") >= 0.1).cast("int") + (F.col("p") >= 0.3).cast("int") + (F.col("p") >= 0.6).cast("int")
    first = F.floor(F.col("i") / 50)
    placed = rows.select("file", "i", active.alias("active"), F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), first)).alias("w"))
    windows = placed.select("file", (F.col("w") * 5000).alias("offset_ms"), (F.col("i") - F.col("w") * 50).alias("frame"), "active")
    return frames.overlap_add(windows, 100.0)


@query("""
WITH l AS (SELECT vec_id AS file, f AS frame, embedding[7 * f + 1 : 7 * f + 7] AS x FROM embeddings, range(9) t(f)),
c AS (SELECT file, frame, list_position(x, list_max(x)) - 1 AS cls FROM l),
t AS (SELECT [[0,0,0],[1,0,0],[0,1,0],[0,0,1],[1,1,0],[1,0,1],[0,1,1]] AS m)
SELECT file, frame::INT AS frame, cls::INT AS cls, m[cls + 1][1] AS s0, m[cls + 1][2] AS s1, m[cls + 1][3] AS s2 FROM c, t""")
def powerset_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The greatest class of each frame and its active speakers."""
    return frames.powerset(A.logits(A.read(spark, d, "embeddings")))


@query("""
WITH v AS (SELECT label AS file, vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings),
p AS (SELECT a.file, a.i, b.i AS j, round(1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 6) AS d FROM v a JOIN v b ON a.file = b.file AND a.i < b.i)
SELECT file, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY d, i, j) AS r FROM p) WHERE r <= 5""")
def cosine_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest pairs of each file."""
    v = A.read(spark, d, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    return cluster.nearest_pairs(v, 5)


_STEPS = "steps AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) - 1 AS step, h AS height FROM (SELECT c_nationkey, c_custkey, round(least(abs(c_acctbal) / 10000, 1.0), 3) AS h FROM customer))"


@query(f"""WITH {_STEPS}, n AS (SELECT *, lead(height) OVER w AS nx, lead(height) OVER w - height AS jump FROM steps WINDOW w AS (PARTITION BY file ORDER BY step)),
b AS (SELECT file, step FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY jump DESC, step) AS r FROM n WHERE nx >= 0.3 AND jump > 0) WHERE r = 1),
o AS (SELECT file, min(CASE WHEN height > 0.55 THEN step END) AS o, count(*) AS n FROM steps GROUP BY file)
SELECT o.file, coalesce(b.step + 1, o.o, o.n) AS merges, b.step IS NOT NULL AS elbow FROM o LEFT JOIN b USING (file)""")
def dendrogram_elbow(spark: SparkSession, d: str) -> DataFrame:
    """Where to cut a tree of merges."""
    from pyspark.sql import Window

    h = F.round(F.least(F.abs("c_acctbal") / 10000, F.lit(1.0)), 3)
    rows = A.read(spark, d, "customer").select(F.col("c_nationkey").alias("file"), "c_custkey", h.alias("height"))
    w = Window.partitionBy("file").orderBy("height", "c_custkey")
    return cluster.merge_count(rows.select("file", (F.row_number().over(w) - 1).cast("long").alias("step"), "height"))


@query()
def agglomerative_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Four clusters of the vectors of each label."""
    v = A.read(spark, d, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    return cluster.cluster(v, max_speakers=4)


_TOKENS = """toks AS (SELECT conv_id, 3 * pos + k AS pos, pos * 5 + k AS frame, CASE WHEN k = 0 AND pos % 7 = 6 THEN '▁' WHEN k = 1 THEN (CASE WHEN pos % 7 = 6 THEN '' ELSE '▁' END) || substr(w, 1, 2) WHEN k = 2 THEN substr(w, 3) END AS token
  FROM words, range(3) t(k))"""


@query(f"""WITH {A.WORDS}, {_TOKENS}, k AS (SELECT * FROM toks WHERE token IS NOT NULL AND token <> '' AND token <> '▁' AND token NOT IN ('<unk>', '<pad>', '<blk>', '<blank>', '<s>', '</s>') AND NOT starts_with(token, '<|')),
s AS (SELECT *, sum(CASE WHEN n = 1 OR starts_with(token, '▁') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS word FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM k))
SELECT conv_id, word::BIGINT AS word, replace(string_agg(token, '' ORDER BY pos), '▁', '') AS text, min(frame) AS first, max(frame) AS last FROM s GROUP BY conv_id, word""")
def decode_words(spark: SparkSession, d: str) -> DataFrame:
    """Token ids to pieces with word marks, and those to words with frames."""
    w = F.col("w")
    lone = F.col("pos") % 7 == 6
    mark = F.when(lone, F.lit("")).otherwise(F.lit(tokens.MARK))
    piece = F.array(F.when(lone, F.lit(tokens.MARK)), F.concat(mark, F.substring(w, 1, 2)), F.substring(w, 3, 1 << 30))
    rows = _words(spark, d).select("conv_id", "pos", F.posexplode(piece).alias("k", "token")).where("token is not null and token <> ''")
    rows = rows.select("conv_id", (F.col("pos") * 3 + F.col("k")).alias("pos"), (F.col("pos") * 5 + F.col("k")).alias("frame"), F.xxhash64("token").alias("id"), "token")
    vocabulary = rows.select("id", "token").distinct()
    return tokens.decode_words(tokens.lookup(rows.drop("token"), vocabulary))


def _segments(spark, d):
    """Conversation turns as rendered segments, speakers and overlaps included."""
    words = _words(spark, d)
    turns, segs = A.turns(words), A.spans(words).withColumnRenamed("turn", "id")
    found = intervals.mark_overlaps(segs, A.regions(turns), turns)
    return found.select(
        "conv_id", "id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text", T.speaker_label(F.col("speaker")).alias("speaker"),
        F.transform("speakers", T.speaker_label).alias("speakers"), "overlap",
    )


def _headers(segments: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("id", "text")))
    return segments.groupBy("conv_id").agg(F.max("end_s").alias("duration_s"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text")).select(
        "conv_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("file"), "duration_s", F.when(F.col("conv_id") % 3 == 0, "").otherwise("es").alias("language"),
        F.lit("stub").alias("model"), F.lit("CPU").alias("device"), "text",
    )


_MARKED = ORACLES["mark_overlaps"].replace("speaker, f IS NOT NULL AS overlap", "speaker, text, f IS NOT NULL AS overlap").replace("array_to_string([CASE WHEN i = 1 THEN f[pl] WHEN i = pl THEN f[1] ELSE f[i] END FOR i IN range(1, len(f) + 1)], ',')", "[CASE WHEN i = 1 THEN f[pl] WHEN i = pl THEN f[1] ELSE f[i] END FOR i IN range(1, len(f) + 1)]").replace("array_to_string(f, ',')", "f").replace("WHEN f IS NULL THEN ''", "WHEN f IS NULL THEN []")
_LABEL = "('Hablante ' || (speaker + 1))"
_CO = "array_to_string(['Hablante ' || (x + 1) FOR x IN speakers[2:]], ', ')"
_CLOCK = "printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_HMS = "CASE WHEN {s} >= 3600 THEN printf('%dh%02dm%02ds', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%dm%02ds', {s} // 60 % 60, {s} % 60) END"


def _clock(c: str, m: str) -> str:
    return _CLOCK.format(c=c, m=m)


def _hms(c: str) -> str:
    return _HMS.format(s=f"round({c} / 1000)::BIGINT")


_CUES = f"WITH marked AS ({_MARKED}), cues AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS n FROM marked WHERE text <> '')"


@query(f"""{_CUES} SELECT conv_id, string_agg(n || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || {_LABEL} || CASE WHEN overlap THEN ' [+' || {_CO} || ']' ELSE '' END || ': ' || text || chr(10) || chr(10), '' ORDER BY id) AS body FROM cues GROUP BY conv_id""")
def render_srt(spark: SparkSession, d: str) -> DataFrame:
    """SubRip."""
    return render.srt(_segments(spark, d), "conv_id")


@query(f"""{_CUES} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || '<v ' || {_LABEL} || '>' || text || chr(10) || chr(10), '' ORDER BY id) AS body FROM cues GROUP BY conv_id""")
def render_vtt(spark: SparkSession, d: str) -> DataFrame:
    """K6: WebVTT."""
    return render.vtt(_segments(spark, d), "conv_id")


@query(f"{_CUES} SELECT conv_id, string_agg({_LABEL} || ': ' || text, chr(10) ORDER BY id) AS body FROM cues GROUP BY conv_id")
def render_txt(spark: SparkSession, d: str) -> DataFrame:
    """K2: plain text."""
    segs = _segments(spark, d)
    return render.txt(segs, _headers(segs), "conv_id")


@query(f"""{_CUES} SELECT conv_id, '# Transcripción — conv-' || conv_id || '.wav' || chr(10) || chr(10) || '- **Modelo:** stub (CPU)' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '- **Idioma:** es' || chr(10) END
  || '- **Duración:** ' || {_hms('max(end_ms)')} || chr(10) || chr(10) || string_agg('`[' || {_hms('start_ms')} || ' → ' || {_hms('end_ms')} || ']` **' || {_LABEL} || CASE WHEN overlap THEN ' (+' || {_CO} || ')' ELSE '' END || ':** ' || text || chr(10) || chr(10), '' ORDER BY id) AS body
FROM cues GROUP BY conv_id""")
def render_md(spark: SparkSession, d: str) -> DataFrame:
    """K3, F2: Markdown."""
    segs = _segments(spark, d)
    return render.md(segs, _headers(segs), "conv_id", timestamps=True)


_ITEM = f"""'{{\n    "id" : ' || id || ',\n    "start" : ' || (start_ms / 1000)::DOUBLE || ',\n    "end" : ' || (end_ms / 1000)::DOUBLE || ',\n    "text" : ' || to_json(text)::VARCHAR || ',\n    "speaker" : "' || {_LABEL} || '"'
  || CASE WHEN overlap THEN ',\n    "speakers" : [ ' || array_to_string(['"Hablante ' || (x + 1) || '"' FOR x IN speakers], ', ') || ' ],\n    "overlap" : true' ELSE '' END || '\n  }}'"""


@query(f"""{_CUES} SELECT conv_id, '{{\n  "version" : "1.0",\n  "source" : {{\n    "file" : "conv-' || conv_id || '.wav",\n    "duration_s" : ' || (max(end_ms) / 1000)::DOUBLE || ',\n    "language" : "' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'es' END
  || '"\n  }},\n  "model" : {{\n    "name" : "stub",\n    "device" : "CPU"\n  }},\n  "segments" : [ ' || string_agg({_ITEM}, ', ' ORDER BY id) || ' ],\n  "text" : ' || to_json(string_agg(text, ' ' ORDER BY id))::VARCHAR || '\n}}' AS body FROM marked GROUP BY conv_id""")
def render_json(spark: SparkSession, d: str) -> DataFrame:
    """K4: JSON without nulls, empty lists and false overlaps."""
    segs = _segments(spark, d)
    return render.json(segs, _headers(segs), "conv_id")


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS cue FROM conversations""")
def clean_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cue texts on one line."""
    return A.read(spark, d, "conversations").select("conv_id", "turn", T.clean_cue(F.col("text")).alias("cue")).where("cue <> ''")


@query("""
WITH r AS (SELECT o_orderpriority AS host, sum(l_quantity) AS a, sum(l_tax * l_quantity) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority)
SELECT host, count(*) AS runs, round(sum(a), 4) AS audio_s, round(sum(t), 4) AS total_s, CASE WHEN sum(a) > 0 THEN round(round(sum(t), 4) / round(sum(a), 4), 6) ELSE 0 END AS rtf FROM r GROUP BY host""")
def rtf_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Real-time factors by host."""
    items = A.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("audio_s"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("total_s"))
    runs = A.read(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("host"), "audio_s", "total_s")
    return trace.run_metrics(runs)


@query(f"""WITH {A.WORDS}, {A.SPANS}, b AS (SELECT conv_id, turn // 2 AS block, turn AS seg, turn // 2 * 10000 AS bs, start_ms, end_ms, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text, 'lang' || (turn % 3) AS language, 'dev' || (turn % 2) AS device FROM spans),
h AS (SELECT conv_id, min_by(language, seg) AS language, max_by(device, seg) AS device FROM b GROUP BY conv_id),
k AS (SELECT conv_id, count(*) AS n, min(start_ms + bs) AS f, max(end_ms + bs) AS l, string_agg(text, ' ' ORDER BY seg) AS t FROM b WHERE trim(text) <> '' GROUP BY conv_id)
SELECT conv_id, coalesce(n, 0) AS n_segments, f AS first_ms, l AS last_ms, coalesce(t, '') AS text, language, device FROM h LEFT JOIN k USING (conv_id)""")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    """Block results on the file's clock."""
    rows = A.spans(_words(spark, d))
    block = F.floor(F.col("turn") / 2)
    segs = rows.select(
        "conv_id", block.alias("block"), F.col("turn").alias("seg"), (block * 10000).alias("block_start_ms"), "start_ms", "end_ms", F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")).alias("text"),
        F.concat(F.lit("lang"), (F.col("turn") % 3).cast("string")).alias("language"), F.concat(F.lit("dev"), (F.col("turn") % 2).cast("string")).alias("device"),
    )
    return packing.concat_blocks(segs)


@query("""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1) AS "window", f AS first, least(1000, n_chars - f) AS real
FROM (SELECT doc_id, n_chars, unnest(generate_series(0, n_chars - 1, 500)) AS f FROM documents WHERE n_chars > 0)""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows, the last ones padded."""
    return packing.sliding_windows(A.read(spark, d, "documents"), 1000, 500, "n_chars", "doc_id")


@query(f"WITH {A.FRAMES} SELECT file, i // 8 AS frame, count(*) AS n, round(sum(p), 6) AS total FROM frames GROUP BY ALL")
def tumbling_frames(spark: SparkSession, d: str) -> DataFrame:
    """Fixed frames."""
    return packing.tumbling(_frames(spark, d), 8, "p").withColumn("total", F.round("total", 6))


@query(r"""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array('Glosario: ' || CASE WHEN turn % 2 = 0 THEN '' ELSE role_ END || ' ' || coalesce(prev, ''), '\s+'), lambda x: x <> '') AS x FROM (SELECT p.*, 'temas' AS role_ FROM p))
SELECT conv_id, turn, len(x) AS n_all, array_to_string(x[-200:], ' ') AS tail FROM t""")
def prompt_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 200 white-space tokens of the prompt."""
    from pyspark.sql import Window

    rows = A.read(spark, d, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    init = F.concat(F.lit("Glosario: "), F.when(F.col("turn") % 2 == 0, "").otherwise("temas"))
    every = tokens.prompt_tail(init, F.col("prev"), 1 << 30)
    return rows.select("conv_id", "turn", F.size(every).cast("long").alias("n_all"), F.array_join(tokens.prompt_tail(init, F.col("prev")), " ").alias("tail"))


_SPACE = r"\t-\r \x{85}\p{Z}"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}\x01]+|[{_SPACE}]+"


#: DuckDB has no look-ahead: a mark (U+0001) cuts the last character off white space that a piece follows.
@query(f"""WITH m AS (SELECT doc_id, regexp_replace(text, '([{_SPACE}]+)([{_SPACE}][^{_SPACE}])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '{_PIECE.replace("'", "''")}') AS x FROM m)
SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS digest FROM p""")
def pretokenize_regex(spark: SparkSession, d: str) -> DataFrame:
    """F16: how many pieces each document has, and the digest of them."""
    pieces = tokens.pretokens(F.col("text"))
    return A.read(spark, d, "documents").select("doc_id", F.size(pieces).cast("long").alias("n"), F.md5(F.array_join(pieces, "|").cast("binary")).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN b LIKE '%qualcomm%' OR b LIKE '%snapdragon%' OR b LIKE '%oryon%' THEN 'Qualcomm' WHEN b LIKE '%intel%' THEN 'Intel'
  WHEN b LIKE '%amd%' OR b LIKE '%ryzen%' THEN 'Amd' WHEN b LIKE '%apple%' THEN 'Apple' ELSE 'Unknown' END AS vendor
FROM (SELECT *, lower(['Snapdragon X ', 'Intel Core ', 'AMD Ryzen ', 'Apple M', 'VIA '][(p_partkey % 5 + 1)::INT] || p_name) AS b FROM part)""")
def brand_vendor(spark: SparkSession, d: str) -> DataFrame:
    """makers from processor names."""
    makes = F.array(*[F.lit(x) for x in ("Snapdragon X ", "Intel Core ", "AMD Ryzen ", "Apple M", "VIA ")])
    brand = F.concat(F.element_at(makes, (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_name"))
    return A.read(spark, d, "part").select("p_partkey", T.vendor(brand).alias("vendor"))


@query("SELECT s_suppkey, lower(regexp_replace(s_name || ' (GPU)', '[^A-Za-z0-9]', '', 'g')) AS slug FROM supplier")
def slug_labels(spark: SparkSession, d: str) -> DataFrame:
    """labels as file name parts."""
    return A.read(spark, d, "supplier").select("s_suppkey", T.slug(F.concat("s_name", F.lit(" (GPU)"))).alias("slug"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE lang END AS language, coalesce(CASE WHEN lang IN ('en', 'es') THEN lang END, 'auto') AS code FROM documents""")
def lookup_language(spark: SparkSession, d: str) -> DataFrame:
    """Requested languages, and codes by id with a default."""
    asked = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<|"), F.upper("lang"), F.lit("|>"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), F.col("lang"))).otherwise("AUTO")
    return A.read(spark, d, "documents").select("doc_id", tokens.resolve_language(asked, ["en", "de", "fr", "es"]).alias("language"), tokens.language_code(F.col("lang"), {"en": "en", "es": "es"}).alias("code"))


@query("""SELECT r_name AS id, count(n_name) AS files, count(*) FILTER (n_name IS NOT NULL AND s IS NULL) AS missing, count(n_name) > 0 AND count(*) FILTER (n_name IS NOT NULL AND s IS NULL) = 0 AS present
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_nationkey % 5 <> 2) ON s = n_nationkey GROUP BY r_name""")
def catalog_presence(spark: SparkSession, d: str) -> DataFrame:
    """Which models have all their files."""
    nation, region = A.read(spark, d, "nation"), A.read(spark, d, "region")
    wanted = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("r_name").alias("id"), F.col("n_name").alias("name"))
    there = A.read(spark, d, "supplier").where("s_nationkey % 5 <> 2").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return batch.presence(wanted, there)


@query("""SELECT p_partkey, CASE WHEN a THEN 1 ELSE least(greatest(least(CASE WHEN r = 0 THEN 8 ELSE r END, greatest(f, 1)), 1), greatest(floor(ram * 0.7 / CASE WHEN m THEN 1.5 ELSE 1.0 END), 1)) END::BIGINT AS jobs
FROM (SELECT p_partkey, p_partkey % 11 = 0 AS a, p_size % 12 AS r, p_partkey % 20 AS f, (p_size / 2)::DOUBLE AS ram, p_partkey % 2 = 0 AS m FROM part)""")
def resolve_jobs(spark: SparkSession, d: str) -> DataFrame:
    """How many files to work on at a time."""
    model = F.when(F.col("p_partkey") % 2 == 0, "whisper-large").otherwise("parakeet")
    n = batch.jobs(F.lit(8), F.col("p_size") / 2, F.col("p_size") % 12, F.col("p_partkey") % 20, model, F.col("p_partkey") % 11 == 0)
    return A.read(spark, d, "part").select("p_partkey", n.alias("jobs"))


_MEL = "CASE WHEN {f} >= 1000 THEN 15 + ln(greatest({f}, 1.0) / 1000) / (ln(6.4) / 27) ELSE {f} * 3 / 200 END"
_HZ = "CASE WHEN {m} >= 15 THEN 1000 * exp(({m} - 15) * (ln(6.4) / 27)) ELSE {m} * 200 / 3 END"


@query(f"""WITH top AS (SELECT {_MEL.format(f='8000.0::DOUBLE')} AS t), e AS (SELECT i, {_HZ.format(m='(i * t / 129)')} AS hz FROM range(130) r(i), top),
m AS (SELECT a.i AS mel, a.hz AS lo, b.hz AS mid, c.hz AS hi FROM e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2)
SELECT freq, mel, round(greatest(least((freq * 40.0 - lo) / (mid - lo), (hi - freq * 40.0) / (hi - mid)), 0) * 2 / (hi - lo), 6) AS weight FROM m, range(201) f(freq)""")
def mel_filterbank(spark: SparkSession, d: str) -> DataFrame:
    """triangular filters of equal area."""
    from ..operators.signal import mel_filterbank as bank

    return bank(spark)


@query(r"""SELECT DISTINCT path FROM (SELECT 'in/' || page_id || '.bin' AS path FROM pages UNION ALL
SELECT regexp_replace(url, '[?#].*$', '') || ['.wav', '.MP3', '.txt', ''][(page_id % 4 + 1)::INT] AS path FROM pages) WHERE path LIKE 'in/%.bin' OR regexp_matches(lower(path), '\.(wav|mp3)$')""")
def input_listing(spark: SparkSession, d: str) -> DataFrame:
    """Named files and listed media, each once."""
    pages = A.read(spark, d, "pages")
    named = pages.select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".bin")).alias("path"))
    ends = F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", "")])
    listed = pages.select(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(ends, (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    return batch.gather_inputs(named, listed)


@query("SELECT count(*) FILTER (toxic = 0) AS ok, count(*) FILTER (toxic <> 0) AS failed FROM labels")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many files went well."""
    return batch.summary(A.read(spark, d, "labels").select(F.when(F.col("toxic") != 0, "failed").alias("error")))
