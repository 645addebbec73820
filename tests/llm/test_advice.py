"""Cases in which an operator once did less than the whole job."""

import random


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "in", "on", "ha", "nd", "es", "re", "ti"]) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    from vetstone.llm import op06_minhash as o

    rng = random.Random(1)
    texts = [prose(rng, 80) for _ in range(12)]
    rows = [(None, t) for t in texts] + [(7, prose(rng, 80)), (7, texts[0] + " more"), (7, prose(rng, 80)), (8, texts[3]), (None, texts[5]), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in o.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*rows[:13], rows[14], *rows[17:]]))
    got = sorted(str((r.doc_id, r.class_id)) for r in o.near_classes(docs).collect())
    assert got == sorted(map(str, [*[(None, None)] * 14, (7, 7), (7, None), (7, 7), (8, None), (7, 7)]))


def same_tag(rng, tail=""):
    """Two different texts whose hashes agree in their low 15 bits."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    s = SparkSession.getActiveSession()
    rows = s.createDataFrame([(f"{prose(rng, 30 + k % 5)} {k} {tail}".strip(),) for k in range(1500)], "t string")
    pair = rows.groupBy(F.xxhash64("t").bitwiseAND(F.lit(0x7FFF)).alias("h")).agg(F.sort_array(F.collect_list("t")).alias("t")).where("size(t) > 1").orderBy("h").first()
    return pair.t[:2]


def test_substring_operators_keep_texts_of_one_id_apart(spark):
    from vetstone.llm import op08_suffix_dedup, op09_substring_dedup

    rng = random.Random(3)
    a, b = same_tag(rng)
    shared = prose(rng, 60)
    c, d = same_tag(rng, shared)
    # b repeats nothing, c and d only `shared`, at places that differ
    rows = [(1, a + " " + shared), (5, a), (5, b), (6, c), (6, d), (None, "first " + prose(rng, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.kept for r in op09_substring_dedup.remove_repeats(docs).where("doc_id = 5").collect()}
    assert got == {"", b}
    kept = {bytes(r.kept).decode() for r in op08_suffix_dedup.remove_repeats(docs).where("doc_id = 5").collect()}
    assert kept == {"", b}
    for r in op09_substring_dedup.remove_repeats(docs).where("doc_id = 6").collect():
        assert r.n_removed == 60 and r.kept in {c[: -len(shared)].strip(), d[: -len(shared)].strip()}


def test_near_copies_meet_however_often_one_repeats_a_passage():
    """Set similarity 20 / 25, weights far apart: 24 bands miss one such pair in 300,000, and with weights many."""
    import numpy as np

    from vetstone.llm import op06_minhash as o

    rng = random.Random(7)
    missed = 0
    for k in range(60):
        passage = " ".join(f"p{k}x{i}" for i in range(24))
        rest = " ".join(f"r{k}x{i}" for i in range(84))
        tail = " ".join(f"t{k}x{rng.random()}" for i in range(5))
        a, b = f"{rest} {' '.join([passage] * 200)}", f"{rest} {passage} {tail}"
        raw = np.frombuffer((a + b).encode(), np.uint8)
        doc, g, w = o.weighted(*o.shingles(raw, np.array([0, len(a), len(a) + len(b)])))
        x, y = set(g[doc == 0]), set(g[doc == 1])
        assert len(x & y) >= 0.8 * len(x | y)
        sig = o.prob_minhash(doc, g, w, 2, o.BANDS * o.ROWS).reshape(2, o.BANDS, o.ROWS)
        missed += not (sig[0] == sig[1]).all(1).any()
    assert missed == 0


def test_secret_queries_read_lines_of_any_length(spark, tmp_path):
    from vetstone.operators import secrets
    from vetstone.plans.registry import QUERIES

    line = "a b " * 20_000 + "AKIA" + "ABCDEFGHIJKLMNOP"[::-1] + " c"
    docs = spark.createDataFrame([(1, line, "en", "s", len(line))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("secret_lines", "secret_findings_merged", "secret_findings_ranked"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 1, name
    assert secrets.detect(docs.selectExpr("'x' AS path", "text")).count() == 0


def test_line_dedup_takes_out_short_repeats(spark):
    from vetstone.llm import op07_line_dedup as o

    rows = [(3, "Les.\n\nmore\nAnd ornd."), (1, "Les.\n\none\nLes."), (1, "Les.\n\none\nLes."), (None, "Lez.\n \nx"), (4, "x \nx"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, ((r.doc_id, r.text) for r in o.without_repeats(docs).collect())))
    assert got == sorted(map(str, [(3, "\nmore\nAnd ornd."), (1, "Les.\n\none"), (1, "Les.\n\none"), (None, "Lez.\n \nx"), (4, "x "), (5, None)]))


def test_components_with_crowds(spark, monkeypatch):
    from vetstone.llm import graph

    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 300)] + [(500, k) for k in range(400, 700)] + [(1000 + k, 1001 + k) for k in range(40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    frame = spark.createDataFrame(edges, "a long, b long")
    for crowd in (100_000, 20):
        monkeypatch.setattr(graph, "CROWD", crowd)
        assert {r.n: r.c for r in graph.components(frame).collect()} == label
    assert graph.components(frame.limit(0)).count() == 0
