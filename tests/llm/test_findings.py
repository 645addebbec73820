"""Cases of the second review."""

import random

import numpy as np


def test_suffix_dedup_where_nothing_stands_left_of_the_anchors(spark):
    """Spans of one group that all start with their anchor: their left sides have no bytes."""
    from vetstone.llm import op08_suffix_dedup as o
    from vetstone.llm import repeats as R
    from vetstone.llm.common import Prefix

    def offset(text: str) -> int:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = R.spans(Prefix(raw).grams(o.ANCHOR), Prefix(raw), np.array([0]), np.array([len(raw)]), o.WIDTH, o.ANCHOR)
        return int(x["off"][0])

    rng = random.Random(3)
    while True:
        one = "".join(rng.choices("abcdefghij ", k=o.WIDTH))
        two = one[:-1] + "!"
        if offset(one) == offset(two) == 0:
            break
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in o.remove_repeats(docs).collect()}
    assert got == {1: (0, 0, one), 2: (0, 0, two), 3: (o.WIDTH, 1, "")}
    order, lcp = o.deep_shallow(np.zeros((3, 0), np.uint8))
    assert order.tolist() == [0, 1, 2] and lcp.tolist() == [0, 0, 0]


def test_suffix_dedup_cuts_undecided_spans_in_parts(spark, monkeypatch):
    """The same result however few bytes of undecided spans are cut at once."""
    from vetstone.llm import op08_suffix_dedup as o

    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefghij ", k=240))
    rows = [(i, f"{rng.random()} {passage[i % 7:]}{rng.random()} {passage[: 130 + i]}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def result():
        return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in o.remove_repeats(docs).collect())

    whole = result()
    seen, want = set(), []
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - o.WIDTH + 1):
            w = raw[s : s + o.WIDTH]
            if w in seen:
                gone[s : s + o.WIDTH] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), left))
    assert whole == want
    monkeypatch.setattr(o, "COLD", 300)
    assert result() == want
