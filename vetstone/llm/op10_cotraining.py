"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The content view is measured on the text: shares of kinds of bytes, repetition of words and lines, lengths of words and
lines, and hashed kinds of word shapes. The metadata view never looks at the text's words: source, language, and the
recorded length. Both views start from labelled documents. In each round both score all unlabelled documents, wherever
these are; a view is sure of those beyond a quantile of its own scores over all of them (SURE of either class, in the
classes' proportions), and labels them for the other view, which is fitted on a hash sample of TEACH a round out of them
and on the labelled rows. Each view is then calibrated on labelled documents that it never learned from, and the
calibrated views are combined by a logistic regression, which scores all documents.

Fitted on at most SAMPLE labelled documents of either class, those with the least hashes of their ids. The numbers of
both views of the unlabelled documents are written once to the checkpoint folder and read in each round. Documents whose
crc32 of the id is divisible by 5 are held out: they neither teach nor are taught.

Null text is empty; null metadata is a value of its own; a missing metadata column counts as null. Very long texts are
measured whole, one at a time. Without labels of both classes every score is 0.5. Repeated rows and null ids are scored
as they come. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import Prefix, cut, pieces, string_buffers, table
from vetstone.llm.op01_toxicity import is_held_out
from vetstone.llm.op09_substring_dedup import words_of

SAMPLE = 2000
ROUNDS = 3
#: Share of all unlabelled documents that a view is sure of in a round, and of these how many the other is fitted on.
SURE, TEACH = 0.1, 400
HASHED = 64


def _kinds() -> np.ndarray:
    """Byte -> kind: 0 white space, 1 line feed, 2 small, 3 capital, 4 digit, 5 full stop or comma, 6 other mark, 7 beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    out[[9, 11, 12, 13, 32]] = 0
    out[10] = 1
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[[44, 46]] = 5
    out[128:] = 7
    return out


KINDS = _kinds()


def content(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text, from all of it."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = KINDS[raw]
    counts = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8)
    start, end, first = words_of(raw, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    length = end - start
    some = np.maximum(words, 1)
    hashes = Prefix(raw).slices(start, end)

    def distinct(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        o = np.lexsort((h, owner))
        a, b = owner[o], h[o]
        new = np.ones(len(o), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.bincount(a[new], minlength=n)

    pairs = (owner[1:] == owner[:-1]) if len(owner) > 1 else np.empty(0, bool)
    two = hashes[1:][pairs] * np.uint64(31) + hashes[:-1][pairs] if len(owner) > 1 else np.empty(0, np.uint64)
    again = np.bincount(owner[1:][pairs & (hashes[1:] == hashes[:-1])], minlength=n) if len(owner) > 1 else np.zeros(n)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    feed = raw == 10
    line_start = np.flatnonzero((np.append(True, feed[:-1]) | edge[:-1])[: len(raw)]) if len(raw) else np.empty(0, np.int64)
    line_doc = doc[line_start] if len(raw) else line_start
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    line_end = np.append(line_start[1:], len(raw))
    line_hash = Prefix(raw).slices(line_start, line_end) if len(raw) else np.empty(0, np.uint64)
    # a word's shape: which kinds of bytes it begins and ends with, and its length up to 15
    shape = np.zeros((n, HASHED))
    if len(start):
        code = (kind[start].astype(np.int64) * 8 + kind[end - 1]) * 16 + np.minimum(length, 15)
        np.add.at(shape, (owner, code * 40503 % 65521 % HASHED), 1)
    total = np.maximum(size, 1)[:, None]
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / some - mean**2, 0))
    numbers = [
        np.log1p(words), mean, spread, distinct(owner, hashes) / some, distinct(owner[1:][pairs], two) / some, again / some,
        np.log1p(lines), np.log1p(size / lines), distinct(line_doc, line_hash) / lines, words > 0,
    ]
    return np.hstack([counts / total, np.stack(numbers, 1), np.sqrt(shape / some[:, None])])


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """A row of numbers for each document, from its record alone."""
    out = np.zeros((len(lang), 2 * HASHED + 12))
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, zlib.crc32(f"lang={a}".encode()) % HASHED] = 1
        out[i, HASHED + zlib.crc32(f"source={b}".encode()) % HASHED] = 1
        if c is None:
            out[i, -1] = 1
        else:
            out[i, 2 * HASHED + min(10, int(np.log2(max(c, 0) + 1) * 2 / 3))] = 1
    return out


def learn(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple:
    """A logistic regression on standardised columns, classes of equal weight; y is 0 or 1."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1, scale)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    c = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum()))
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (c * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def logit(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1]


def cotrain(views: list[np.ndarray], y: np.ndarray, teach: Callable[[list[tuple], float, int], list[tuple]], rounds: int = ROUNDS) -> dict:
    """Fits both views on rows with labels y, then calibrates and combines them on rows set aside.

    teach(models, share, round) gives for each view the rows (numbers, labels) that the other one taught it.
    """
    aside = np.arange(len(y)) % 4 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    xs = [[v[~aside]] for v in views]
    ys = [[y[~aside].astype(float)] for _ in views]
    share = max(0.02, min(0.98, y[~aside].mean()))
    taught = [0, 0]
    models = [learn(x[0], t[0]) for x, t in zip(xs, ys, strict=True)]
    for k in range(rounds):
        fresh = teach(models, share, k)
        for view, (x, t) in enumerate(fresh):
            if len(t):
                xs[view].append(x)
                ys[view].append(t)
                taught[view] += len(t)
        if not any(len(t) for _, t in fresh):
            break
        models = [learn(np.concatenate(x), np.concatenate(t)) for x, t in zip(xs, ys, strict=True)]
    held = aside if aside.any() else np.ones(len(y), bool)
    f = np.stack([logit(m, v[held]) for m, v in zip(models, views, strict=True)], 1)
    calibrated = [learn(f[:, [k]], y[held].astype(float), 0.1) for k in (0, 1)]
    g = np.stack([logit(c, f[:, [k]]) for k, c in enumerate(calibrated)], 1)
    return {"views": models, "calibrated": calibrated, "both": learn(g, y[held].astype(float), 0.1), "taught": taught}


def combined(model: dict, views: list[np.ndarray]) -> np.ndarray:
    """Columns: probability of good quality by content, by metadata, and by both."""
    g = [logit(c, logit(m, v)[:, None]) for c, m, v in zip(model["calibrated"], model["views"], views, strict=True)]
    f = np.stack([*g, logit(model["both"], np.stack(g, 1))], 1)
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _columns(docs: DataFrame) -> DataFrame:
    def have(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(have("doc_id", "long"), F.coalesce("text", F.lit("")).alias("text"), have("lang", "string"), have("source", "string"), have("n_chars", "long"))


def views_of(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
    parts = [content(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
    meta = metadata(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("lang", "source", "n_chars")))
    return [np.concatenate(parts) if parts else np.zeros((0, 18 + HASHED)), meta]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, y and both views' numbers: what rounds read, and the driver draws, is these, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x.tobytes() for x in np.clip(v, -60_000, 60_000).astype(np.float16)], pa.binary()) for v in views_of(b))], ["doc_id", "y", "content", "meta"])

    return docs.mapInArrow(run, "doc_id long, y int, content binary, meta binary")


def numbers(col) -> np.ndarray:
    """A view's rows from their bytes."""
    col = list(col)
    return np.frombuffer(b"".join(col), np.float16).astype(float).reshape(len(col), -1) if col else np.zeros((0, 1))


def taught_by(free: DataFrame, models: list[tuple], share: float, turn: int, sure: float = SURE, teach: int = TEACH) -> list[tuple]:
    """What each view learns from the other in a round: all unlabelled documents are scored by both; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [logit(m, numbers(b.column(b.schema.get_field_index(x)).to_pylist())) if b.num_rows else np.empty(0) for m, x in zip(models, ("content", "meta"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *map(pa.array, f)], ["doc_id", "f0", "f1"])

    scores = free.mapInArrow(run, "doc_id long, f0 double, f1 double")
    ends = [sure * (1 - share), 1 - sure * share]
    low_high = scores.agg(*(F.percentile_approx(f"f{k}", F.array(*map(F.lit, ends)), 10_000).alias(f"q{k}") for k in (0, 1))).first()
    out = []
    for view in (0, 1):
        other = 1 - view
        if low_high[other] is None:
            return [(None, np.empty(0)), (None, np.empty(0))]
        low, high = low_high[other]
        f, order = F.col(f"f{other}"), F.xxhash64("doc_id", F.lit(turn), F.lit(view))
        rows = []
        for y, hit, n in ((1.0, (f >= high) & (f > 1.0), round(teach * share)), (0.0, (f <= low) & (f < -1.0), teach - round(teach * share))):
            drawn = scores.where(hit).select("doc_id", F.lit(y).alias("t")).distinct().orderBy(order, "doc_id").limit(n)  # bounded by `teach`
            rows.append(drawn)
        name = ("content", "meta")[view]
        got = free.join(F.broadcast(rows[0].union(rows[1])), "doc_id").select("doc_id", "t", name).dropDuplicates(["doc_id"]).collect()
        got.sort(key=lambda r: r.doc_id)
        out.append((numbers(r[name] for r in got), np.array([r.t for r in got])))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> dict | None:
    """Fits on bounded samples of rows, taught by all unlabelled ones: see the module's text."""
    marks = labels.where(~is_held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("y"))
    drawn = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]).dropDuplicates(["doc_id"]))  # at most 2 * sample rows
    columns = _columns(docs)
    rows = featured(columns.join(chosen, "doc_id").select("doc_id", "y", "text", "lang", "source", "n_chars")).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    y = np.array([r.y for r in rows], int)
    if not (y == 0).any() or not (y == 1).any():
        return None
    free = columns.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(-1).alias("y"), "text", "lang", "source", "n_chars")
    free = cut(featured(free).join(labels.select("doc_id").distinct(), "doc_id", "left_anti"))
    return cotrain([numbers(r[k] for r in rows) for k in ("content", "meta")], y, lambda models, share, turn: taught_by(free, models, share, turn), rounds)


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, content_score, metadata_score, score (0 to 1, higher: better)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = combined(model, views_of(b)) if model else np.full((b.num_rows, 3), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(3))], ["doc_id", "content_score", "metadata_score", "score"])

    return _columns(docs).mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
