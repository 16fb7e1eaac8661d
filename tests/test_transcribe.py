"""From generated WAV files to written transcripts, broken files included."""

import io
import wave

import numpy as np
import pytest

from auralake.operators import batch, engines
from auralake.plans import transcribe as T
from auralake.sources import audio


def wav(x, rate=16_000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        y = np.round(np.clip(np.repeat(x, channels), -1, 1) * (2 ** (8 * width - 1) - 1)).astype("<i4")
        f.writeframes((y + 128).astype("u1").tobytes() if width == 1 else y.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


def tone(seconds, loud=0.5):
    return loud * np.sin(2 * np.pi * 300 * np.arange(int(16_000 * seconds)) / 16_000)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("lost", [0, 1, 2, 5, 44, 1000])
def test_truncated_wav(width, lost):
    whole = wav(tone(0.5), width=width, channels=2)
    x, rate = audio.decode_wav(whole[: len(whole) - lost])
    assert rate == 16_000 and len(x) == (8000 * 2 * width - lost) // (2 * width)
    assert np.abs(x - tone(0.5)[: len(x)]).max() < 0.02


def test_words_keep_literal_text_and_decoding_needs_finite_logits():
    pieces = {0: "▁<3", 1: "<unk>", 2: "<|en|>", 3: "ma"}
    assert [w[0] for w in engines.words_of([0, 1, 2, 3], [0, 1, 2, 3], pieces, 1.0)] == ["<3ma"]
    with pytest.raises(ValueError):
        engines.duration_decode(lambda at, state: (np.full(3, np.nan), np.zeros(2), None), 2, 2, (0, 1))


def inputs(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")


def test_process(spark, tmp_path):
    long = np.concatenate([tone(20), np.zeros(32_000), tone(15), np.zeros(16_000)])
    files = [("/in/a.wav", wav(tone(1.5))), ("/in/b.wav", wav(long)), ("/in/c.wav", b"RIFF"), ("/in/d.wav", wav(tone(1, 0.02)) [:-1]), ("/in/a.mp3", wav(tone(1)))]
    options = T.Options(fmt="srt", folder=str(tmp_path), voice=T.energy_voice)
    done = T.process(spark, inputs(spark, files), options).collect()
    assert [r.path for r in done] == ["/in/a.mp3", "/in/a.wav", "/in/b.wav", "/in/c.wav", "/in/d.wav"]
    errors = {r.path: r.error for r in done}
    assert errors["/in/a.mp3"] is None and errors["/in/a.wav"].startswith("exists") and errors["/in/c.wav"].startswith("decoding") and errors["/in/b.wav"] is None
    assert "bajo bajo" in (tmp_path / "d.srt").read_text() and not (tmp_path / "c.srt").exists()
    cues = (tmp_path / "b.srt").read_text().split("\n\n")
    assert cues[0].startswith("1\n00:00:00,") and cues[1].startswith("2\n00:00:2") and len([c for c in cues if c]) == 2
    again = T.process(spark, inputs(spark, [("/in/a.wav", wav(tone(3)))]), options)
    assert again.first().error.startswith("exists") and [tuple(r) for r in batch.summary(again).collect()] == [(0, 1)]
    forced = T.Options(fmt="srt", folder=str(tmp_path), force=True)
    assert T.process(spark, inputs(spark, [("/in/a.wav", wav(tone(3)))]), forced).first().error is None
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_speakers(spark, tmp_path):
    halves = T.Options(fmt="txt", folder=str(tmp_path), turns=lambda x, rate: [(0.0, 1.0, 0), (1.0, 2.0, 1)], regions=lambda x, rate: [(0.0, 2.0)])
    T.process(spark, inputs(spark, [("/in/s.wav", wav(tone(2)))]), halves).collect()
    assert (tmp_path / "s.txt").read_text().split("\n") == ["Hablante 1: alto alto", "Hablante 2: alto alto"]
    segment = "path string, id long, start_s double, end_s double, text string, words " + T.WORDS
    rows = spark.createDataFrame([("x", 0, 0.0, 0.9, "uno", []), ("x", 1, 1.1, 2.0, "dos", []), ("y", 0, 0.0, 1.0, "tres", [])], segment)
    turns = spark.createDataFrame([("x", 0, 0, 1000, 0), ("x", 1, 1000, 2000, 1)], "path string, idx long, start_ms long, end_ms long, speaker long")
    assert sorted((r.path, r.id, r.speaker) for r in T.named(rows, turns, None).collect()) == [("x", 0, 0), ("x", 1, 1), ("y", 0, None)]


def test_options():
    for bad in ({"fmt": "doc"}, {"regions": len}, {"timestamps": True, "fmt": "srt"}):
        with pytest.raises(ValueError):
            T.Options(**bad)
