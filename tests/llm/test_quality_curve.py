"""The compression classifier against plain code: every score by compressors of its own, and the curve as the least loss."""

import math
import random
import zlib

import zstandard

from auralake.llm import quality
from auralake.llm.common import table


def plain_size(text: bytes, raw: bytes) -> int:
    made = zstandard.ZstdCompressionDict(raw) if raw else None
    return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text))


def plain_difference(text: bytes, model) -> float:
    if not text:
        return 0.0
    bad, good = plain_size(text, model.bad), plain_size(text, model.good)
    return (bad - good) / ((bad + good) / 2)


def test_scores_of_all_documents(spark, small):
    docs = table(spark, small, "documents")
    model = quality.train(docs, table(spark, small, "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    got = quality.op4_zstd_quality(spark, small).collect()
    assert len(got) == len(texts) and {r.doc_id for r in got} == set(texts)
    for r in got:
        want = 1 / (1 + math.exp(-(model.slope * plain_difference(texts[r.doc_id], model) + model.offset)))
        assert abs(r.score - want) < 1e-9
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_curve_has_the_least_loss():
    r = random.Random(4)
    words = [["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro", "alpha"]]
    rows = [(y, " ".join(r.choices(words[y if r.random() < 0.8 else 1 - y], k=60)).encode()) for y in (r.randrange(2) for _ in range(400))]
    share = 0.7
    model = quality.fit(rows, share)
    held = [(y, plain_difference(t, model)) for i, (y, t) in enumerate(rows) if i % quality.CALIBRATE == 0]
    good = sum(y for y, _ in held) / len(held)

    def loss(slope, offset):
        total = (1e-4 * slope**2 + 1e-6 * offset**2) / 2
        for y, x in held:
            z = slope * x + offset
            total += (share / good if y else (1 - share) / (1 - good)) * (math.log1p(math.exp(-abs(z))) + max(z, 0) - z * y)
        return total

    least = loss(model.slope, model.offset)
    assert model.slope > 0
    for step in (1e-3, 1e-2, 0.1, 1.0):
        for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)):
            assert loss(model.slope + a * step, model.offset + b * step) >= least - 1e-9
