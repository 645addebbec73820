"""The pipeline's stages on a small corpus with planted cases, against what must go and what must stay."""

import random


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    syllables = ["the", "an", "er", "in", "on", "ha", "nd", "es", "re", "ti", "wh", "ou"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    item = prose(40)
    docs = [(i, prose(80)) for i in range(300)]
    for i in range(0, 300, 4):
        w = docs[i][1].split()
        for _ in range(5):
            w[rng.randrange(80)] = rng.choice(["idiot", "moron", "scum"])
        docs[i] = (i, " ".join(w))
    toxic = {i for i in range(0, 300, 4)}
    docs[11] = (11, prose(20) + " " + item + " " + prose(20))
    copy = docs[21][1].split()
    copy[40] = "other"
    docs[201] = (201, " ".join(copy))
    docs[31] = (31, prose(50) + "\n" + docs[33][1] + "\n" + prose(50))
    docs.append((300, None))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i, _ in docs[:300]], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == frame.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in frame.collect()})
    after_toxicity = set(kept[0])
    assert len(after_toxicity & toxic) <= 4 and len(set(range(301)) - toxic - after_toxicity) <= 4
    assert set(kept[1]) == after_toxicity
    assert docs[31][1] != kept[1][31].text or docs[33][1] != kept[1][33].text
    assert 21 in kept[2] and 201 not in kept[2] and len(kept[2]) >= len(kept[1]) - 2
    assert set(kept[2]) - set(kept[3]) == {11}
    assert set(kept[4]) == set(kept[3]) and 300 in kept[4]


def test_run(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "sequence_id" in out.columns


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice(["the", "an", "er", "in", "on", "ha"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    item, same = prose(30), prose(60)
    rows = [(None, prose(60)), (None, prose(60)), (None, None), (1, ""), (2, same), (2, same), (3, same), (2, prose(60)), (4, prose(20) + " " + item), (5, prose(30_000)), (6, "line one of some length here\n" * 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, d string, score string, item_id string"
    frame = spark.createDataFrame([(i, t, None, None, None, "d", "s", "q") for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", item), ("none", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start, want in ((frame, [11, 11, 10, 9]), (frame.limit(0), [0] * 4)):
        docs, got = start, []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k == 4:
                assert out.count() >= got[-1] and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
                break
            assert out.columns == frame.columns, name
            out.write.parquet(path := f"{tmp_path}/{k}-{start.count()}")
            docs = spark.read.parquet(path)
            got.append(docs.count())
        assert got == want
