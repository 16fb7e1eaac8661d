"""Rendering, clocks, tokens, traces, files, signals, audio, engines."""

import io
import json
import math
import wave

import numpy as np
from pyspark.sql import functions as F

from auralake.functions import text as T
from auralake.operators import batch, engines, render, signal, tokens, trace
from auralake.sources import audio

SEG = "conv_id long, id long, start_s double, end_s double, text string, speaker string, speakers array<string>, overlap boolean"
HEAD = "conv_id long, file string, duration_s double, language string, model string, device string, text string"


def two(spark, speaker=None, speakers=(), overlap=False):
    rows = [(0, 0, 0.0, 2.0, "hola", speaker, list(speakers), overlap), (0, 1, 2.0, 4.2, "mundo", None, [], False)]
    return spark.createDataFrame(rows, SEG), spark.createDataFrame([(0, "f.wav", 4.2, "es", "m", "CPU", "hola mundo")], HEAD)


def body(df):
    return df.first().body


def test_render(spark):
    segs, head = two(spark)
    assert body(render.txt(segs, head, "conv_id")) == "hola mundo"
    assert body(render.srt(segs, "conv_id")) == "1\n00:00:00,000 --> 00:00:02,000\nhola\n\n2\n00:00:02,000 --> 00:00:04,200\nmundo\n\n"
    vtt = body(render.vtt(segs, "conv_id"))
    assert vtt.startswith("WEBVTT\n\n") and "00:00:02.000 --> 00:00:04.200" in vtt
    md = body(render.md(segs, head, "conv_id", True))
    assert md.startswith("# Transcripción — f.wav\n\n- **Modelo:** m (CPU)\n- **Idioma:** es\n- **Duración:** 0m04s\n\n`[0m00s → 0m02s]` hola\n\n")
    doc = json.loads(body(render.json(segs, head, "conv_id")))
    assert doc["version"] == "1.0" and doc["segments"][0] == {"id": 0, "start": 0.0, "end": 2.0, "text": "hola"}


def test_render_overlap(spark):
    segs, head = two(spark, "Hablante 1", ("Hablante 1", "Hablante 2"), True)
    assert "**Hablante 1 (+Hablante 2):** hola" in body(render.md(segs, head, "conv_id"))
    assert "\nHablante 1 [+Hablante 2]: hola\n" in body(render.srt(segs, "conv_id"))
    assert "<v Hablante 1>hola" in body(render.vtt(segs, "conv_id"))
    assert body(render.txt(segs, head, "conv_id")) == "Hablante 1: hola\nmundo"
    seg = json.loads(body(render.json(segs, head, "conv_id")))["segments"][0]
    assert seg["overlap"] is True and seg["speakers"] == ["Hablante 1", "Hablante 2"]


def test_blank_cues(spark):
    segs = spark.createDataFrame([(0, 0, 0.0, 1.0, "   ", None, [], False), (0, 1, 1.0, 2.0, "a\n\n b", None, [], False), (1, 0, 0.0, 1.0, "", None, [], False)], SEG)
    got = {r.conv_id: r.body for r in render.srt(segs, "conv_id").collect()}
    assert got == {0: "1\n00:00:01,000 --> 00:00:02,000\na b\n\n", 1: ""}
    assert {r.conv_id: r.body for r in render.vtt(segs, "conv_id").collect()}[1] == "WEBVTT\n\n"


def one(spark, c, **values):
    kinds = {float: "double", int: "long", str: "string", list: "array<double>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(c.alias("x")).first().x


def test_scalars(spark):
    c = F.col("v")
    assert [one(spark, T.clock(c), v=x) for x in (4.2, -1.0, math.nan, 360000.0004)] == ["00:00:04,200", "00:00:00,000", "00:00:00,000", "100:00:00,000"]
    assert [one(spark, T.spoken(c), v=x) for x in (123.0, 3723.4)] == ["2m03s", "1h02m03s"]
    assert one(spark, T.strip(c), v=" a b ") == "a b"
    assert one(spark, T.vendor(c), v="Snapdragon(R) X Elite") == "Qualcomm" and one(spark, T.slug(c), v="DirectML (GPU)") == "directmlgpu"
    assert [one(spark, T.output_path(c, "srt"), v=x) for x in ("/a/b.mp4", "x.tar.gz", "/a/.mp3")] == ["/a/b.srt", "x.tar.srt", "/a/.mp3.srt"]
    assert [one(spark, T.argmax(c), v=x) for x in ([1.0, 3.0, 3.0], [math.nan, -math.inf], [math.nan, math.inf, 1.0])] == [1, None, 2]
    assert one(spark, T.prompt(c, F.lit("  ")), v=" a ") == "a"
    assert one(spark, T.cosine_distance(c, F.array(F.lit(0.0), F.lit(0.0))), v=[1.0, 2.0]) == 1.0


def test_tokens(spark, tmp_path):
    (tmp_path / "v.txt").write_text("<unk> 0\n▁hola 1\n▁mun 2\ndo 3\nbad line\n<blk> 4\n")
    v = tokens.read_vocabulary(spark, str(tmp_path / "v.txt"))
    assert tokens.blank_id(v).first().blank == 4
    for ids in ((1, 2, 3), range(5), (1, 2, 3, 99)):
        rows = spark.createDataFrame([(0, p, i) for p, i in enumerate(ids)], "k long, pos long, id long")
        assert tokens.decode(rows, v, ["k"]).first().text == "hola mundo"
    pieces = [(0, p, t, p) for p, t in enumerate(["▁a", "b", "▁", "c", "▁d"])]
    got = tokens.decode_words(spark.createDataFrame(pieces, "conv_id long, pos long, token string, frame long")).orderBy("word").collect()
    assert [(r.text, r.first, r.last) for r in got] == [("abc", 0, 3), ("d", 4, 4)]
    assert len(set(tokens.byte_alphabet().values())) == 256
    assert tokens.merge(list("abc"), {("a", "b"): 0, ("ab", "c"): 1}) == ["abc"] and tokens.merge(list("abc"), {("b", "c"): 0}) == ["a", "bc"]


def test_bpe_round_trip(spark):
    ids = {c: i for i, c in enumerate(tokens.byte_alphabet().values())} | {"Ġh": 256, "Ġho": 257}
    ranks = {("Ġ", "h"): 0, ("Ġh", "o"): 1}
    rows = spark.createDataFrame([("¡Qué tal, hola! \n x",), ("",), (" ho's 12",)], "t string")
    out = rows.withColumn("ids", tokens.encode_column(ranks, ids)(tokens.pretokens(F.col("t")))).withColumn("back", tokens.decode_column(ids)("ids")).collect()
    assert all(r.back == r.t for r in out) and out[2].ids[0] == 257


def test_language(spark):
    got = spark.createDataFrame([("<|ES|>",), (" auto ",), ("",), (None,), ("en",)], "v string").select(tokens.resolve_language(F.col("v"), ["es", "en"]).alias("x")).collect()
    assert [r.x for r in got] == ["es", None, None, None, "en"]


def test_trace(spark, tmp_path):
    events = [{"name": "a_kernel_time", "dur": 10, "args": {"provider": "X"}}, {"name": "b_kernel_time", "args": {"provider": "Y"}}, {"name": "c_fence", "dur": 5, "args": {"provider": "X"}}, {"name": "d_kernel_time", "dur": 7}]
    (tmp_path / "prof_1.json").write_text(json.dumps(events))
    (tmp_path / "prof_2.json").write_text("{not json")
    (tmp_path / "other.json").write_text("[]")
    kernels, bad = trace.read_traces(spark, str(tmp_path))
    got = trace.provider_share(kernels).orderBy("place").collect()
    assert [(r.provider, r.nodes, r.pct_nodes, r.ms, r.pct_time) for r in got] == [("X", 1, 50.0, 0.01, 100.0), ("Y", 1, 50.0, 0.0, 0.0)]
    assert [r.file for r in bad.collect()] == ["prof_2.json"]


def test_batches(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    paths = batch.gather_inputs(df([("x.bin",), ("b.mp3",)], "path string"), df([("b.mp3",), ("c.WAV",), ("d.txt",)], "path string"))
    assert [r.path for r in paths.collect()] == ["b.mp3", "c.WAV", "x.bin"]
    made = batch.outputs(df([("a.mp3",), ("a.wav",)], "path string"), "srt").orderBy("path").collect()
    assert [(r.out_path, r.collides) for r in made] == [("a.srt", False), ("a.srt", True)]
    done = batch.writable(batch.outputs(df([("a.mp3",), ("b.wav",)], "path string"), "srt"), df([("b.srt",)], "out_path string"))
    assert tuple(batch.summary(done).first()) == (1, 1)
    cat = batch.catalogue(spark, '[[model]]\nid="m"\nkind="asr"\n[[model.file]]\nname="f"\nsha256="ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"\n')
    wanted = cat.select("id", F.explode("file").alias("f")).select("id", "f.name", "f.sha256")
    assert batch.verify(wanted, df([("f", bytearray(b"abc"))], "name string, content binary")).first().ok
    assert not batch.verify(wanted, df([("f", bytearray(b"abd"))], "name string, content binary")).first().ok
    assert not batch.presence(wanted.select("id", "name"), df([("g",)], "name string")).first().present
    j = lambda *a: one(spark, batch.jobs(*[F.lit(x) for x in a]), v=1)
    assert [j(8, 4.0, 8, 8, "parakeet", False), j(8, 6.0, 8, 8, "whisper", False), j(8, 0.5, 4, 4, "parakeet", False), j(8, 64.0, 4, 4, "parakeet", False), j(8, 64.0, 4, 4, "parakeet", True)] == [2, 2, 1, 4, 1]


def test_signal():
    t = np.arange(8000) / 16000
    x = np.sin(2 * np.pi * 220 * t) + 0.5 * np.sin(2 * np.pi * 880 * t)
    y = signal.istft(signal.stft(x), len(x))
    assert np.abs(y - x)[512:-512].max() < 1e-3
    m = signal.log_mel(0.5 * np.sin(2 * np.pi * 440 * np.arange(32000) / 16000))
    assert m.shape == (128, 3000) and m.min() >= -1.001 and m.max() <= 1.5 and abs((m.max() - m.min()) - 2) < 0.01
    bank = signal.mel_matrix()
    assert bank.shape == (201, 128) and (bank >= 0).all() and (bank.sum(0) > 0).all()
    assert list(signal.downmix(np.array([1, 3, 2, 4.0]), 2)) == [2, 3] and list(signal.downmix(np.array([1, 2, 3, 4.0]), 4)) == [2.5]
    assert len(signal.resample(x, 44100, 16000)) == round(8000 * 16000 / 44100) and signal.resample(x[:0], 8000, 16000).size == 0
    assert signal.fbank(x).shape == (48, 80) and signal.fbank(x[:10]).shape == (0, 80)


def wav(x, rate, channels):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.repeat(x, channels) * 32000).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.sin(2 * np.pi * 440 * np.arange(44100) / 44100), 44100, 2))
    (tmp_path / "b.WAV").write_bytes(wav(np.sin(2 * np.pi * 440 * np.arange(8000) / 16000), 16000, 1))
    (tmp_path / "c.mp3").write_bytes(b"none")
    (tmp_path / "d.txt").write_bytes(b"none")
    got = {r.path[-5:]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.wav", "b.WAV", "c.mp3"}
    assert abs(len(got["a.wav"].samples) - 16000) < 5 and len(got["b.WAV"].samples) == 8000 and got["c.mp3"].error_class == "Audio"


def test_engines(spark):
    rows = [("f", 1, 28000, [0.5] * 16000, 16000), ("f", 0, 0, [0.0] * 8000, 16000), ("g", 0, 0, [0.1], 8000)]
    blocks = spark.createDataFrame(rows, "path string, block long, start_ms long, samples array<float>, sample_rate int")
    got = engines.transcribe_blocks(blocks, "stub", language="es")
    by = {(r.path, r.block): r for r in got.collect()}
    assert by["f", 0].segments[0].text == "bajo" and "16000 Hz" in by["g", 0].error
    segs = engines.rebased(got).orderBy("id").collect()
    assert [(r.id, r.start_s, r.text) for r in segs] == [(0, 0.0, "bajo"), (1, 28.0, "alto alto")] and segs[1].words[1].start == 28.5
    step = lambda at, state: (np.array([0.0, 1.0 if (state or 0) < 2 else -1.0]), np.array([1.0, 0.0]), (state or 0) + 1)
    assert engines.duration_decode(step, 3, 0, (0, 1)) == ([1, 1], [0, 0])
    assert engines.greedy(lambda ids: [0.0, 1.0, 2.0 if len(ids) > 3 else 0.5, 9.0], [7], 2, above=2) == [1, 1, 1]
