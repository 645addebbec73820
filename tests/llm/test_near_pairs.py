"""op6: what large buckets cost, and that none of their links is lost."""

import random

import numpy as np


def drifting(seed=5, families=3, copies=60):
    """Texts that drift away from one passage, a few words at a time."""
    r, out = random.Random(seed), []
    for f in range(families):
        texts = [[f"w{f}_{k}" for k in range(120)]]
        for _ in range(copies):
            text = list(r.choice(texts[:8]))
            for _ in range(r.randint(1, 7)):
                text[r.randrange(len(text))] = f"x{r.randrange(40)}"
            texts.append(text)
        out += [" ".join(x) for x in texts]
    return [(k, x) for k, x in enumerate(out)]


def test_parities_never_exceed_the_difference():
    from vetstone.llm.op06_minhash import parities

    r = np.random.default_rng(1)
    for many in (1, 10, 100, 2000):
        x, y = (np.unique(r.integers(0, 3000, many)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        a, b = (parities(np.zeros(len(v), np.int64), v, 1).view(np.uint64) for v in (x, y))
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))


def test_large_buckets_lose_no_link_and_verify_few_pairs(spark, monkeypatch):
    from vetstone.llm import op06_minhash as o

    docs = spark.createDataFrame(drifting(), "doc_id long, text string").coalesce(2)
    met, verified, differences = [], o.verified, o.differences

    def counted(pairs, sets, threshold=o.THRESHOLD):
        out = verified(pairs, sets, threshold)
        met.append((pairs.count(), out.count()))
        return out

    def once(*args):
        rows, links = differences(*args)
        # a checkpoint ends the join of differences: it isn't run again for each use of the rows
        assert "often" not in rows._jdf.queryExecution().optimizedPlan().toString()
        return rows, links

    monkeypatch.setattr(o, "verified", counted)
    monkeypatch.setattr(o, "differences", once)
    whole = {(x.d, x.least) for x in o.classes(docs, full=10**9).collect()}
    pairs, links = met[-1]
    assert pairs <= 4 * links + 20
    met.clear()
    assert {(x.d, x.least) for x in o.classes(docs, full=1, split=1).collect()} == whole
