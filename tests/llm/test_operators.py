"""Training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import bpe, decontam, exact_dedup, licenses, lm, ngram_join, quality, shards, urls, warc
from auralake.llm import attention as A
from auralake.llm.components import components

SCHEMA = "doc_id long, text string, id string, rep string, n long, token long, node long, content string"


def words(r, n):
    return " ".join(r.choice("the of and thon erea inging blest tion ndti heth onst wher anes 12 A.".split()) + r.choice(["", "", ".", "x", "yz"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = words(r, 120)
    out = [None, "", " \n ", "one", "one", "two words", "a b c d", "A B C D", base, base, base + " end", base.upper(), words(r, 3000), "x" * 5000, "tab\tand\x0bfeed  two  spaces\n\n"]
    for i in range(12):
        w = base.split()
        w[i * 9 % 120] = f"edit{i}"
        out.append(" ".join(w))
    out += [words(r, r.randint(1, 60)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y", 1, 2, 3, "z") for i, t in enumerate(texts)] + [(3, "one", "x", "y", 1, 2, 3, "z"), (None, "one", "x", "y", 1, 2, 3, "z"), (None, "no id", "x", "y", 1, 2, 3, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(docs):
    return docs.where("false")


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs):
    want, rows = collections.defaultdict(list), pairs(docs)
    for i, t in rows:
        want[t].append(i)
    for limit in (exact_dedup.TABLE_BYTES, 3000):  # the second recurses
        got = exact_dedup.exact_groups(docs, table_bytes=limit).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id, r.text_sha256): r for r in got}
        for t, ids in want.items():
            keep = max((i for i in ids if i is not None), default=None)
            for i in ids:
                r = by[i, hashlib.sha256(t.encode()).hexdigest()]
                assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


def test_drop_copies_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert (True, 0, "no id") in got and (True, 0, "one") not in got and (False, 4, "one") in got and (False, 3, "one") not in got


def test_content_table_compares_contents():
    t = exact_dedup.ContentTable(4)
    assert [t.find_or_add(7, c) for c in (b"a", b"b", b"a", b"c", b"d", b"b")] == [0, 1, 0, 2, 3, 1]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, k, percent):
    known = docs.where("doc_id is not null")
    want = brute_components(dict(pairs(known)).items(), k, percent)
    got = ngram_join.join_components(docs, k=k, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert {r.component_id for r in got if r.doc_id is None} == {3, None}


def test_ngram_join_of_nothing_and_prefixes(docs):
    assert ngram_join.join_components(empty(docs)).count() == 0
    r = np.random.default_rng(4)
    level = r.integers(0, 20, ngram_join.LEAST_CELLS).astype(np.uint8)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 62, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.07], r.integers(0, 1 << 62, r.integers(0, 6)).astype(np.uint64)]))
        if ngram_join.similar(a, b):
            (p, _, m), (q, _, n) = ngram_join.prefix(a, level), ngram_join.prefix(b, level)
            assert len(np.intersect1d(p, q)) >= min(m, n)


def test_ngram_join_of_repeated_ids_and_hot_tokens(spark, monkeypatch):
    r = random.Random(8)
    a, b = words(r, 60), words(r, 60)
    near = lambda t, w: " ".join(t.split()[:-1] + [w])
    rows = [(1, a), (1, b), (2, near(b, "other")), (3, near(a, "other")), (None, near(b, "more")), (7, near(near(b, "more") + " tail", "else"))]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id or 0, x.component_id) for x in got.collect()) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 1)]
    # Every set has the boilerplate's shingles, and groups are dealt out in parts.
    monkeypatch.setattr(ngram_join, "PART", 4)
    shared = words(r, 40)
    bodies = [words(r, 30) for _ in range(12)]
    rows = [(i, f"{shared} {bodies[i % 12]} {'' if i < 36 else words(r, 2)}") for i in range(60)] + [(100 + i, f"{words(r, 2)} {shared}") for i in range(30)]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, 4, 85)


def test_ngram_sketch():
    r = np.random.default_rng(3)
    cells = np.unique(r.integers(0, 1 << 20, 3000)).astype(np.uint32)
    n = r.integers(1, 200_000, len(cells))
    for i, j in ((0, len(cells)), (5, 9), (2, 2)):
        at, counts = ngram_join._unpacked(ngram_join._packed(cells[i:j], n[i:j]))
        assert (at == cells[i:j]).all() and (counts == n[i:j]).all()
    h = r.integers(0, 1 << 63, 500).astype(np.uint64)
    big, small = (ngram_join.cell_of(h, c) for c in (ngram_join.MOST_CELLS, ngram_join.LEAST_CELLS))
    wide, slim = (c // ngram_join.SLABS for c in (ngram_join.MOST_CELLS, ngram_join.LEAST_CELLS))
    assert (big // wide == small // slim).all() and (big % wide % slim == small % slim).all()


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs.where("doc_id is not null"))
    want = brute_components(dict(pairs(docs.where("doc_id is not null"))).items(), 4, 85)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} and kept.columns == docs.columns


def test_shards(docs, spark):
    got = shards.assign(docs, shards=4).collect()
    more = {r.doc_id: r.shard for r in shards.assign(docs, shards=4).collect()}
    assert sorted(r.size for r in got) == sorted(len(t.encode()) + 1 for _, t in pairs(docs))
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    crc = collections.Counter(zlib.crc32(t.encode()) for _, t in pairs(docs))
    assert crc == collections.Counter(r.text_crc32 for r in got)
    for r in got:
        assert r.grown_shard in (r.shard, 4) and more[r.doc_id] == r.shard
    assert shards.assign(empty(docs)).count() == 0
    first = shards.initial_map(spark, 4, 64)
    grown = shards.grow_map(first, 4)
    assert collections.Counter(r.shard for r in grown.collect()) == {0: 13, 1: 13, 2: 13, 3: 13, 4: 12}


def test_stored_maps(spark, docs, tmp_path):
    folder = f"{tmp_path}/maps"
    first = shards.store_map(shards.initial_map(spark, 4, 64), folder)
    second = shards.store_map(shards.grow_map(first, 4), folder)
    rows = shards.assign(docs, shards=4, slots=64)
    sizes = shards.slot_sizes(rows)
    third = shards.store_map(shards.rebalance_map(second, sizes.select("virtual_slot", "bytes"), 5), folder)
    assert {r.version for r in shards.read_map(spark, folder).collect()} == {2} and third.count() == shards.read_map(spark, folder, 0).count() == 64
    assert {(r.virtual_slot, r.bytes) for r in sizes.collect()} == {(r.virtual_slot, r.slot_bytes) for r in rows.collect()}
    of = {r.virtual_slot: r.shard for r in shards.read_map(spark, folder, 1).collect()}
    assert all(r.grown_shard == of[r.virtual_slot] for r in rows.collect())
    with pytest.raises(Exception, match="exists"):
        shards.store_map(second, folder)


def test_rebalance(spark):
    first = shards.initial_map(spark, 4, 64)
    size = {s: 100 + (900 if s % 4 == 1 else 0) for s in range(64)}
    sizes = spark.createDataFrame(list(size.items()), "virtual_slot int, bytes long")
    new = shards.rebalance_map(first, sizes, 4).collect()
    load = collections.Counter()
    for r in new:
        load[r.shard] += size[r.virtual_slot]
    assert len(new) == 64 and max(load.values()) - min(load.values()) <= 2000 and {r.version for r in new} == {1}
    assert sum(r.shard != r.virtual_slot % 4 for r in new) < 16


def test_bpe_is_the_library_s(docs):
    import public_tokenizers
    import tiktoken

    b = bpe.PrefixBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    r = random.Random(1)
    alphabet = [*" \n\t  \x85\x1c '!.,_ab12²½trñé漢🙂", "  ", "'s", "'ll", "the", "ing"]
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 20))) for _ in range(3000)] + ["a" * 500]
    enc = bpe.TextEncoder(b, public_tokenizers.PATTERN, held=200)
    for i in range(0, len(cases), 100):
        for t, packs in zip(cases[i : i + 100], enc.packs(cases[i : i + 100]), strict=True):
            assert [x for p in packs for x in p] == lib.encode_ordinary(t)
    got = collections.Counter((x.doc_id, tuple(x.ids), bytes(x.decoded), x.n_tokens) for x in bpe.encode_column(docs).collect())
    assert got == collections.Counter((i, tuple(lib.encode_ordinary(t)), t.encode(), len(lib.encode_ordinary(t))) for i, t in pairs(docs))
    digests = collections.Counter((x.doc_id, x.ids_sha256, x.decoded_sha256) for x in bpe.encode_digests(docs).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert digests == collections.Counter((i, sha(",".join(map(str, lib.encode_ordinary(t))).encode()), sha(t.encode())) for i, t in pairs(docs))
    packed = {(x.doc_id, bytes(x.token_ids)) for x in bpe.encode_packed(docs).collect()}
    assert packed == {(i, np.array(lib.encode_ordinary(t), "<u4").tobytes()) for i, t in pairs(docs)}
    assert bpe.encode_column(empty(docs)).count() == 0


def test_bpe_keeps_words_in_use_when_its_cache_is_full():
    import public_tokenizers

    cut = []
    enc = bpe.TextEncoder(bpe.PrefixBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, held=20)
    whole = enc.split
    enc.split = lambda text: cut.append(text) or whole(text)
    for i in range(40):
        text = f" often seen n{i} m{i} k{i}"
        assert [i for p in next(enc.packs([text])) for i in p] == [i for m in whole(text) for i in enc.bpe.encode_piece(m.encode())]
        assert len(enc.words) <= 20 and len(enc.older) <= 20
    assert cut.count(" often") == cut.count(" seen") == 1 and cut.count(" n7") == 1


def test_spilled_long_rows_lie_in_small_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from auralake.llm import common

    def noise(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([random.Random(i).randbytes(1 << 20) for i in range(b.num_rows)], pa.binary())], names=["id", "x"])

    rows = spark.range(0, 40, 1, 1).mapInArrow(noise, "id long, x binary")
    made = common.spill(rows, "long-rows", long_rows=True)
    (path,) = glob.glob(made._spilled.removeprefix("file:") + "/*.parquet")
    groups = [pq.read_metadata(path).row_group(i) for i in range(pq.read_metadata(path).num_row_groups)]
    assert sum(g.num_rows for g in groups) == made.count() == 40 and max(g.total_byte_size for g in groups) < 12 << 20


def test_bpe_tables_append_and_edit():
    import public_tokenizers

    b = bpe.PrefixBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(9)
    some = lambda n: bytes(r.choice(b"theingaosrt e") for _ in range(n))
    for _ in range(60):
        p = bpe.EditablePiece(b, some(r.randint(0, 300)))
        p.append(some(r.randint(0, 20)))
        at = r.randint(0, len(p.piece))
        p.edit(at, min(len(p.piece), at + r.randint(0, 5)), some(r.randint(0, 5)))
        fresh = [-1]
        b.extend(p.piece, fresh)
        assert p.last == fresh and p.ids() == b.encode_piece(p.piece) and b.decode(p.ids()) == p.piece
    long = bpe.EditablePiece(b, some(3000))
    assert long.edit(100, 101, b"q") < 1000


def test_quality(spark, docs):
    r = random.Random(3)
    good = lambda: words(r, 60)
    bad = lambda: " | ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(9999, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    got = quality.score(table, model).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got) and 80 < len(held) < 160
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in held) >= 0.95 * len(held)
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in odd)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty(docs), model).count() == 0
    none = quality.train(table, labels.where("false"))
    assert {x.score for x in quality.score(docs, none).collect()} and 0 < quality.probability(b"a", none) < 1


def test_urls(spark):
    made = [(0, "http://a.com/x"), (1, "http://EXAMPLE.com/en/1?q"), (2, "https://www.example.com/en/2"), (3, "http://b.net/es/3#f"), (4, "ftp://c.net/fr/"), (5, "d.com/x"), (6, None), (7, ""), (8, "http://com"), (9, "http://xcom/en/"), (10, "http://m.example.com/en"), (11, "http://e.org?u=http://a.net/es/")]
    made += [(100 + i, f"http://n{i}.net/{'es' if i % 2 else 'fr'}/{i}{'?a=1&b=2' * (i % 3)}") for i in range(60)] + [(200 + i, f"http://n{i}.com/{i}") for i in range(60)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(made, "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(12)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, "com/", None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[1].host, got[1].path) == ("example.com", "/en/1") and (got[5].host, got[5].path) == ("", "") and (got[8].host, got[8].path) == ("com", "") and (got[11].host, got[11].path) == ("e.org", "")
    assert all((got[i].score >= 0.5) == (i < 200) for i in got if i >= 100) and all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://e.org/")], "page_id long, url string")).collect()} <= {"allow", "block"}


def test_trees_find_a_split(spark):
    rows = [(f"http://h{i}.net/{'1' * (40 if i % 2 else 2)}", f"h{i}.net", "/" + "1" * (40 if i % 2 else 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, host string, path string, y long")
    model = urls.train(df, trees=3, depth=2)
    got = urls.binned(df, model).withColumn("p", model.score()).collect()
    assert all((r.p > 0.5) == bool(r.y) for r in got) and model.trees[0].feature


@pytest.mark.parametrize("sent", [100_000, 5])
def test_every_suffix_has_its_rate(spark, monkeypatch, sent):
    monkeypatch.setattr(urls, "SENT_SUFFIXES", sent, raising=False)  # the second joins by shuffle
    rows = [(f"http://h.d{i}.net/{j}", f"h.d{i}.net", f"/{j}", i % 2) for i in range(100, 250) for j in range(10)]
    df = spark.createDataFrame([*rows, ("http://h.none.net/1", "h.none.net", "/1", None)], "url string, host string, path string, y long")
    model = urls.train(df.where("y is not null"), trees=3, depth=2)
    got = urls.binned(df, model).withColumn("p", model.score()).collect()
    mean = (750 + 1) / 1502
    want = {y: sum(x <= (10 * y + 10 * mean) / 20 for x in urls.BORDERS["suffix2_rate"]) for y in (0, 1)} | {None: sum(x <= mean for x in urls.BORDERS["suffix2_rate"])}
    assert len(got) == 1501 and all(r.suffix2_rate == want[r.y] and (r.y is None or (r.p > 0.5) == bool(r.y)) for r in got)


def test_warc(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/é ?\n").alias("url"), F.col("text").alias("html"), "id", "content")
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    first = {}
    for i, t in rows:
        if i is not None and (t not in first or i < first[t]):
            first[t] = i
    want = collections.Counter()
    for i, t in rows:
        again = len(t.encode()) >= 100 and t in first and i != first[t]
        want[i, len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), "revisit" if again else "response", first[t] if again else None] += 1
    assert want == collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert any(r.record_type == "revisit" for r in got)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    one = b"".join(bytes(r.content) for r in archives.collect())
    kinds = collections.Counter(r.kind for r in warc.read_archive([one[i : i + 7] for i in range(0, len(one), 7)]))
    assert kinds.pop("warcinfo") == archives.count() and sum(kinds.values()) == len(rows)


def foreign(lines, block):
    return zlib.compress(b"WARC/1.0\r\n" + b"".join(f"{x}\r\n".encode() for x in lines) + b"\r\n" + block + b"\r\n\r\n", wbits=31)


def test_warc_of_others(spark, docs, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    chunked = b"3\r\nabc\r\n4;x=y\r\ndefg\r\n0\r\n\r\n"
    head = lambda kind, n, *more: [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "Content-Type: application/http; msgtype=response", f"Content-Length: {n}", *more]
    one = foreign(head("response", len(http + chunked)), http + chunked)
    lying = b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n" + b"x" * 200
    two = foreign(head("response", len(lying), "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"x" * 200).digest()).decode()), lying)
    other = foreign(["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:3>", "Content-Length: 2"], b"ab")
    again = foreign(head("revisit", 0, "WARC-Refers-To: <urn:uuid:1-2>", "WARC-Payload-Digest: sha1:XYZ"), b"")
    archives = spark.createDataFrame([(bytearray(warc.write_info("a") + one + two + other + again),), (None,)], "content binary")
    got = [tuple(r) for r in warc.read_archives(archives).collect()]
    digest = [hashlib.sha256(x).hexdigest() for x in (b"abcdefg", b"x" * 200)]
    assert got == [(None, None, 7, digest[0], "response", None, "urn:uuid:1-2", None), (None, None, 200, digest[1], "response", None, "urn:uuid:1-2", None), (None, None, None, None, "revisit", None, "urn:uuid:1-2", "urn:uuid:1-2")]
    assert warc.read_archives(archives, kinds=("warcinfo", "metadata")).count() == 2
    bad = [two[:-9], foreign(head("response", len(lying), "WARC-Payload-Digest: sha1:" + "A" * 32), lying), foreign(["WARC-Type: response"], b""), foreign(["Content-Length: 0"], b""),
           foreign(head("response", "x"), b""), foreign(head("response", len(http) + 4), http + b"zz\r\n"), foreign(["nonsense"], b"")]
    for x in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive([x]))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"))
    made = warc.write_archives(pages)
    saved = warc.save_archives(made, f"{tmp_path}/warcs").collect()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/warcs/*.warc.gz")
    assert files.count() == len(saved) and sorted(map(str, warc.read_archives(files).collect())) == sorted(map(str, warc.read_archives(made).collect()))


def test_warc_finds_damage():
    ok = warc.write_record("response", "1", None, b"abc", hashlib.sha256(b"abc").hexdigest())
    assert next(warc.read_archive([ok])).payload == b"abc"
    plain = zlib.decompress(ok, 31)
    for broken in (plain.replace(b"abc", b"abd"), plain.replace(b"abc", b"abcd"), plain[:-2], b"no" + plain):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive([zlib.compress(broken, wbits=31)]))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive([ok[:-5]]))


def test_licenses(spark):
    rows = [
        (0, "a/b/c.txt", "some text of the file itself, longer than its notice\nReleased under the MIT License."), (1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/d/e/f.txt", "nothing here"),
        (3, "a/x.txt", None), (4, None, "plain"), (5, "LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "a/b/d/LICENSE", "Licensed under CC BY-NC 4.0."),
        (7, "a/b/z.txt", ""), (8, "a/q.txt", "the license of mit und 2 code " * 300), (8, "a/q.txt", "the license of mit und 2 code " * 300),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [(got[i].license, got[i].inherited, got[i].from_dir) for i in range(8)] == [
        ("MIT", False, None), ("Apache-2.0", False, None), ("CC-BY-NC-4.0", True, "a/b/d"), (None, False, None), (None, False, None), ("GPL-3.0", False, None), ("CC-BY-NC-4.0", False, None), ("Apache-2.0", True, "a/b"),
    ]
    assert [got[i].is_file for i in (0, 1, 5, 6)] == [False, True, True, True] and licenses.scan(df).count() == 10 and licenses.scan(df.where("false")).count() == 0


def test_license_files_of_full_texts(spark):
    full = dict(licenses.full_texts())
    rows = [(i, f"{name}/COPYING", text) for i, (name, text) in enumerate(full.items())] + [(100 + i, f"{name}/src/a.c", "int main;") for i, name in enumerate(full)]
    v = licenses.Vectors(tuple(full.items()))
    edited = "Copyright (c) 2031 Some Body, all of it\n\n" + " ".join(full["MIT"].replace("MIT License", "").split())
    rows += [(200, "own/LICENSE", edited), (201, "own/x", "nothing"), (202, "long/LICENSE", full["MIT"] + " other words here" * 400), (203, "long/x", "nothing"), (204, "two/LICENSE", edited), (205, None, edited)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(full):
        assert (got[i].license, got[i].is_file, got[i].inherited, got[i].score) == (name, True, False, 1.0)
        assert (got[100 + i].license, got[100 + i].is_file, got[100 + i].inherited, got[100 + i].from_dir) == (name, False, True, name)
    c = collections.Counter(w for w in re.findall(licenses.TOKEN, edited.lower()) if w not in licenses.STOP)
    vec, k = {w: n * v.idf.get(w, v.other) for w, n in c.items()}, v.names.index("MIT")
    want = sum(x * v.vectors[k].get(w, 0) for w, x in vec.items()) / math.sqrt(sum(x * x for x in vec.values())) / v.norms[k]
    assert want >= licenses.FILE_COSINE and all(abs(got[i].score - want) < 1e-6 and got[i].is_file and got[i].license == "MIT" for i in (200, 204, 205))
    assert (got[201].license, got[201].inherited, got[202].is_file, got[203].license) == ("MIT", True, False, None) and len(got) == len(rows)


def test_license_scores_like_brute_force(spark):
    r = random.Random(4)
    v = licenses.Vectors()
    terms = sorted(v.idf) + ["word", "other"]
    texts = [". ".join(" ".join(r.choice(terms) for _ in range(r.randint(1, 9))) for _ in range(3)) for _ in range(150)] + [t for _, t in licenses.TEMPLATES]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame([(i, "p/q", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()}
    for i, t in enumerate(texts):
        best = None
        for h in re.split(licenses.CUT, t):
            c = collections.Counter(w for w in re.findall(licenses.TOKEN, h.lower()) if w not in licenses.STOP)
            vec = {w: n * v.idf.get(w, v.other) for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in vec.values()))
            for name, own, m in zip(v.names, v.vectors, v.norms, strict=True):
                s = (sum(x * own.get(w, 0) for w, x in vec.items()) / norm / m if norm else 0, name)
                best = max(best, s) if best else s
        assert (got[i].score is not None) == (best[0] >= licenses.COSINE - 1e-7)
        if got[i].score is not None:
            assert abs(got[i].score - best[0]) < 1e-6


def test_decontamination(spark, docs):
    r = random.Random(8)
    items = [(i, f"{words(r, r.randint(8, 30))}. {' '.join(f'w{i}x{j}' for j in range(12))}? It is a{i} b{i}.") for i in range(30)] + [(30, None), (31, ""), (None, "Alone question here now today. The end.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 + i, words(r, r.randint(0, 500)) + " " + (items[i][1].upper().replace(" ", "\n") if i < 20 else "") + " " + words(r, 100)) for i in range(30)] + [(None, items[0][1]), (1, None), (2, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("score", F.lit(0))
    for size in (decontam.ITEMS, 7):
        got = sorted({(x.doc_id or 0, x.item_id) for x in decontam.find_leaks(texts, bench, items=size).collect()})
        assert got == sorted([(100 + i, i) for i in range(20)] + [(0, 0)])
        assert decontam.drop_leaks(texts, bench, items=size).count() == 12
    assert decontam.find_leaks(texts, bench.where("false")).count() == 0 and decontam.find_leaks(texts.where("false"), bench).count() == 0
    half = spark.createDataFrame([(1, items[3][1].split("?")[0])], "doc_id long, text string")
    assert decontam.find_leaks(half, bench).count() == 0  # the answer is missing


def test_retrieval_is_complete():
    r = random.Random(6)
    items = [(i, words(r, r.randint(3, 40)) + f". k{i} l{i % 7}") for i in range(80)]
    own = [[w for p in decontam.question_and_answer(t) for w in p] for _, t in items]
    df = collections.Counter(w for x in own for w in set(x))
    index = decontam.Index.build(items, df, len(items), sum(map(len, own)) / len(own))
    for _ in range(60):
        query = [r.choice(list(index.terms)) for _ in range(r.randint(1, 300))]
        for least in (0.2, 0.4, 0.6):
            got = {s: {a for b in blocks for a, _ in index.search(q, least, b)} for s, q, blocks in index.passages(query, least)}
            for s in range(0, len(query), index.longest):
                scores = collections.Counter()
                for t in {index.terms[w] for w in query[s : s + 2 * index.longest]}:
                    for a, x in zip(*index.postings[t], strict=True):
                        scores[a] += x
                assert {a for a, x in scores.items() if x >= least - 1e-9} == got.get(s, set())


def test_language_model(spark, docs):
    rows, counts = pairs(docs), collections.Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            counts.update([*t.encode().lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    lm_small, lm.SENT_WORDS = lm.SENT_WORDS, 5  # most words take the joined path
    try:
        got = lm.score_texts(docs).collect()
    finally:
        lm.SENT_WORDS = lm_small
    want = collections.Counter()
    for i, t in rows:
        w = [*t.encode().lower().split(), 0]
        want[i, held[i], len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score_texts(empty(docs)).count() == 0


def test_language_model_learns_from_every_window_once(spark, monkeypatch):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sums, whole = [], lm.summed
    monkeypatch.setattr(lm, "summed", lambda blobs, dtype: sums.append((dtype, whole(blobs, dtype))) or sums[-1][1])
    r = random.Random(11)
    rows = [(i, words(r, r.randint(0, 200))) for i in range(60)]
    for n, chunk in ((20, 2000), (60, lm.CHUNK_BYTES)):
        sums.clear()
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        lm.score_texts(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(3))
        ids = [sum(len(lib.encode_ordinary(" " + w)) for w in t.lower().split()) for i, t in rows[:n] if zlib.crc32(str(i).encode()) % 10]
        assert sum(x[-1] for kind, x in sums if kind == "float64") == sum(-(-(k + 1) // (2 * A.BLOCK)) for k in ids)


def test_language_model_encodes_words_together(monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    import tiktoken
    import xxhash

    name = "byte_bpe_multi_50k.tiktoken"
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(name)), special_tokens={})
    encode, sign = lambda w: lib.encode_ordinary(" " + w.decode()), lambda w: int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64))
    r = random.Random(3)
    plain = [words(r, r.randint(0, 60)) + "  it's 12345 a.b" for _ in range(40)]
    plain += ["", "  ", "\tÉcole \n\x0b ÀB!! ", "x" * 3000, "\x1cb \x1f", "O'S 's"]
    odd = ["a\xa0 \xa0b c", "\u3000 d\u2003e\x85", "\xa0"]  # the pattern joins white space across words
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1500)
    for texts, together in ((plain[:40], True), (plain, False), (plain + odd, False), (odd * 50, False), ([""], True), ([], True)):
        calls, words_ = [], lm._words(name)

        class Counted:
            def encode_to_numpy(self, text, **k):
                calls.append(text)
                return lib.encode_to_numpy(text, **k)

            def encode_ordinary(self, text):
                calls.append(text)
                return lib.encode_ordinary(text)

        monkeypatch.setattr(words_, "encoding", Counted())
        ids, out = [None if i == 7 else i for i in range(len(texts))], [i % 5 == 0 for i in range(len(texts))]
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 9], pa.int64()), pa.array(out[i : i + 9]), pa.array(texts[i : i + 9], pa.string())], names=["a", "b", "c"]) for i in range(0, len(texts), 9)]
        rows = [x for b in lm._prepare(name)(iter(batches)) for x in b.to_pylist()]
        chunks = [lm._Chunk(*(x[k] for k in lm._SENT)) for x in rows if x["kind"] == 0]
        assert [tuple(d) for c in chunks for d in c.docs] == [(i or 0, int(o), int(i is not None), len(t.encode().lower().split())) for i, o, t in zip(ids, out, texts, strict=True)]
        got = [[int(c.hashes[w]) for w in c.words] for c in chunks]
        assert sum(got, []) == [sign(w) for t in texts for w in t.encode().lower().split()]
        tokens = [c.tokens(np.full(len(c.docs), True)) for c in chunks]
        want = [[x for w in t.encode().lower().split() for x in encode(w)] for t in texts]
        assert [int(x) for f, _ in tokens for x in f] == sum(want, []) and [int(n) for _, n in tokens for n in n] == list(map(len, want))
        counts, by_id = collections.Counter(), collections.Counter()
        for x in rows:
            if x["kind"] == 1:
                counts[x["word"]] += x["n"]
        for t, w, o in zip(texts, want, out, strict=True):
            by_id.update([] if o else w)
            counts.subtract([] if o else [sign(x) for x in t.encode().lower().split()])
        assert not any(counts.values())
        total = sum((np.frombuffer(zlib.decompress(x["blob"]), np.int64) for x in rows if x["kind"] == 2), np.zeros(words_.size + 1, np.int64))
        assert total[-1] == len(texts) - sum(out) and {int(i): int(total[i]) for i in np.flatnonzero(total[:-1])} == by_id
        assert not together or len(calls) <= -(-len(chunks) // lm.TOGETHER)  # and not one for each word


def test_exponentials_and_scores_without_the_faster_kernel(monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(0, 20, (50, 3, 7)).astype(np.float32)
    assert np.allclose(A._exp()(x.copy()), np.exp(x), rtol=1e-6)
    texts = [r.integers(0, 40, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 90)]
    vocab, p = A.vocabulary(np.append(np.bincount(np.concatenate(texts), minlength=300), len(texts)).astype(float)), A.fresh()
    with_kernel = A.Scorer(p, vocab).score(*flat(texts))
    monkeypatch.setattr(A, "_exp", lambda: np.exp)
    assert np.allclose(A.Scorer(p, vocab).score(*flat(texts)), with_kernel, rtol=1e-5)
    assert np.allclose(with_kernel, [slow_log10(p, vocab, t) for t in texts], rtol=1e-3)


def slow_log10(p, vocab, ids):
    """A text's log10 probability, one id after the other, by the definition."""
    x, y, total = np.append(vocab.start, ids), np.append(ids, vocab.end), 0.0
    for j, t in enumerate(y):
        first = (j // A.BLOCK - 1) * A.BLOCK
        window = [x[i] if i >= 0 else vocab.start for i in range(first, j + 1)]
        e = p["E"][vocab.row[window]] + p["P"][: len(window)]
        q, k, v = e[-1] @ p["Q"] * A.WIDTH**-0.5, e @ p["K"], e @ p["V"]
        a = np.exp(k @ q)
        h = e[-1] + (a / a.sum()) @ v @ p["O"]
        z = p["U"] @ (h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]) + p["b"]
        share = vocab.share[t] if vocab.after is None else vocab.after[vocab.cls[x[j]], t]
        total += (z[vocab.cls[t]] - np.log(np.exp(z).sum())) / math.log(10) + share
    return total


def flat(texts):
    return np.concatenate(texts).astype(np.int32), np.array([len(x) for x in texts])


def test_attention_is_causal_normalised_and_learns():
    r = np.random.default_rng(0)
    texts = [(np.cumsum(r.integers(1, 3, 50)) % 40).astype(np.int32) for _ in range(120)]
    counts = np.append(np.bincount(np.concatenate(texts), minlength=300), len(texts)).astype(float)
    vocab = A.vocabulary(counts)
    x, y, count = A.rows(*flat(texts), vocab, 2 * A.BLOCK)
    assert (count == 2).all() and (y >= 0).sum() == sum(map(len, texts)) + len(texts)
    pairs = np.zeros((vocab.classes, 301))
    np.add.at(pairs, (vocab.cls[x[y >= 0]], y[y >= 0]), 1)
    vocab = A.vocabulary(counts, pairs[:, :-1])
    p = A.fresh()
    loss, grad = A.gradient(p, vocab, x[:8], y[:8])
    for name in ("Q", "K", "V", "O", "W1", "b1", "W2", "U", "b", "P"):  # by differences
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((A.gradient(up, vocab, x[:8], y[:8])[0] - A.gradient(down, vocab, x[:8], y[:8])[0]) / 2e-2 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-3
    before = A.Scorer(p, vocab).score(*flat(texts[:20])).sum()
    for turn in range(6):
        A.learn(p, vocab, x, y, 0.01, turn, batch=32)
    scorer = A.Scorer(p, vocab)
    assert scorer.score(*flat(texts[:20])).sum() > before
    some = [texts[0], texts[1][:15], texts[2][:0], texts[3][:16], texts[4][:33]]
    for condition in (False, True):
        if condition:
            vocab.condition(np.column_stack([pairs]))
        assert np.allclose(A.Scorer(p, vocab).score(*flat(some), batch=2), [slow_log10(p, vocab, t) for t in some], rtol=1e-3)
    vocab.after = None
    a, b = texts[0][:20], texts[0][:20].copy()
    b[15:] = 7
    one, two = (scorer.rows(*A.windows(*flat([x[:k]]), vocab)[:2]).sum() for x, k in ((a, 15), (b, 15)))
    assert one == two
    ins1, outs1, _ = A.windows(*flat([np.append(a[:10], 0)]), vocab)
    outs1[outs1 == vocab.end] = -1
    mass = 0.0
    for t in range(301):
        outs1[0, 10] = t
        mass += 10 ** scorer.rows(ins1, outs1).sum()
    known = outs1.copy()
    known[0, 10] = -1
    assert abs(mass / 10 ** scorer.rows(ins1, known).sum() - 1) < 1e-3


def test_entry_names_every_operator():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
