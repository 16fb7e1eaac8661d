"""The pipeline's stages on a small corpus: what each drops, and the columns that it keeps."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(11)
    say = lambda n: " ".join(r.choice("the of and thon erea inging blest tion ndti heth onst wher anes".split()) + r.choice(["", "s", "ly"]) for _ in range(n))
    bad = lambda: " | ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    item = " ".join(f"quest{i}" for i in range(20)) + ". Answer one two."
    rows = [(i, say(80) if i % 4 else bad(), "en", "s", 1) for i in range(400)]
    twin = say(100)
    near = twin.split()
    near[50] = "other"
    rows += [(1001, "copy " + twin, "en", "s", 1), (1002, "copy " + twin, "en", "s", 1), (1003, "copy " + " ".join(near), "en", "s", 1), (1004, say(40) + " " + item + " " + say(40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert name == names[-1] or made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    good = {i for i in range(400) if i % 4}
    assert len(good - kept[0]) <= 3 and len(kept[0] & {i for i in range(0, 400, 4)}) <= 5 and {1001, 1002, 1003, 1004} <= kept[0]
    assert kept[0] - kept[1] == {1001} and kept[1] - kept[2] == {1003} and kept[2] - kept[3] == {1004} and kept[4] == kept[3]
    again = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == kept[4]
