"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over their common subsequences of three symbols, LAMBDA to the power of the letters they
span in either, up to SPAN letters, over the strings' norms: an insult with characters inserted keeps most of its
subsequences, all a little lighter, and so its direction. A unit's norm is that of its occurrences: a subsequence that it
has twice counts as two.
Units are words; single characters in a row, as in a spaced-out word, are one unit, and long words are covered by
overlapping stretches. Case is folded, look-alike digits and signs stand for their letters.

Labels are of documents. Landmarks are learned first: fragments of words that set sentences of toxic documents apart
from those of clean ones, chosen greedily until they cover the toxic sample, and frequent clean words. Sentences of
toxic documents that hold such a fragment are labelled toxic, those of clean documents clean; spaced and gapped copies
of the toxic ones join them. What the machine sees of a sentence are its units, so that it learns words and what hides
them, not phrases. A linear machine (squared hinge, Newton steps) on the Nyström features of their units,
with hard clean units added in rounds, gives a decision per unit; a text has its highest, calibrated to 0..1 on the
training documents.

Since features are linear in a unit's subsequences, machine, Nyström map and landmarks fold into one weight for each of
64**3 subsequences, so that a whole corpus is scored in a pass over its bytes without any join.

Fitted on at most SAMPLE labelled documents of either class whose crc32 of the id isn't divisible by 5. Null and empty
texts score as a text without toxic units; without any toxic label every score is 0. Very long texts are scored whole,
one at a time. Repeated rows and null ids are scored as they come. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import re
import subprocess
import sys
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import pieces, string_buffers, table

#: Documents of either class that the machine is fitted on, at most, those with the least hash of their id.
SAMPLE = 900
LAMBDA, SPAN = 0.7, 7
LANDMARKS = 128
STRETCH = 16
#: Clean units of the sample among which hard ones are looked for.
POOL = 30_000
LOW = -1.5
#: Of a unit on the wrong side of the margin.
COST = 10.0
#: Units up to which texts count as equally long.
SHORT = 50
#: Landmarks that a toxic document of the sample should have.
COVERS = 6
GAP = 1  # symbol of characters that are no letters
#: What stands before a word, and after it, so that its ends are part of subsequences; and the symbol.
START, EDGE = "\x02", 63


def _symbols() -> np.ndarray:
    """Byte -> one of 64 symbols: 0 white space, 1 gap, 2..27 letters, 28..62 the bytes of other scripts."""
    out = np.full(256, GAP, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    for i in range(26):
        out[[65 + i, 97 + i]] = 2 + i
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(sign)] = 2 + ord(letter) - 97
    high = np.arange(128, 256)
    high = np.where(high < 192, high | 32, high)  # Latin-1 capitals differ from small letters there
    out[128:] = 28 + (high * 11) % 35
    out[ord(START)] = EDGE
    return out


SYMBOLS = _symbols()
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units_of(sym: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit, and the end of the word it is in; texts lie end to end, white space before each and at the end.

    White space around a word gets the symbol EDGE in `sym`; a word's first unit begins and its last one ends with it.
    """
    n = len(sym)
    ink = sym > 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    if not len(start):
        return start, end, end
    doc = np.searchsorted(offsets, start, "right")
    one = end - start == 1
    glued = np.zeros(len(start), bool)
    glued[1:] = one[1:] & one[:-1] & (start[1:] - end[:-1] == 1) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~glued)
    start, end = start[first], end[np.append(first[1:], len(end)) - 1]
    count = np.maximum(1, -(-(end - start - STRETCH) // (STRETCH // 2)) + 1)
    s = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * (STRETCH // 2)
    word_end = np.repeat(end, count)
    stop = np.minimum(s + STRETCH, word_end)
    sym[start - 1] = EDGE
    sym[end] = EDGE
    last = np.cumsum(count) - 1
    s[last - count + 1] -= 1
    stop[last] += 1
    return s, stop, word_end + 1


def subsequences(sym: np.ndarray, start: np.ndarray, end: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, weight) of every subsequence that starts in a unit and stays in its word; gaps only count as span."""
    size = end - start
    unit = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    room = word_end[unit] - at
    out = []
    for a, b in _PAIRS:
        ok = np.flatnonzero(room > b)
        i = at[ok]
        x, y, z = sym[i], sym[i + a], sym[i + b]
        letters = (x > GAP) & (y > GAP) & (z > GAP)
        code = (x[letters].astype(np.int64) << 12) | (y[letters].astype(np.int64) << 6) | z[letters]
        out.append((unit[ok[letters]], code, np.full(len(code), LAMBDA ** (b + 1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def phi(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of whole strings, a unit each."""
    raw = [s.encode() for s in strings]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    sym = np.maximum(SYMBOLS[np.frombuffer(b"".join(raw), np.uint8)], GAP)
    return subsequences(sym, offsets[:-1], offsets[1:], offsets[1:])


def kernel(strings: list[str], used: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Normalised kernel of each string with each landmark; grid: landmarks' weights of the subsequences `used`."""
    out = np.zeros((len(strings), grid.shape[1]))
    column = np.full(64**3, -1, np.int32)
    column[used] = np.arange(len(used))
    for i in range(0, len(strings), 1000):
        part = strings[i : i + 1000]
        unit, code, w = phi(part)
        hit = column[code] >= 0
        counts = np.bincount(unit[hit] * len(used) + column[code[hit]], w[hit], len(part) * len(used))
        norm = np.sqrt(np.maximum(np.bincount(unit, w * w, len(part)), 1e-9))
        out[i : i + 1000] = (counts.reshape(len(part), -1) @ grid) / norm[:, None]
    return out


def fold(text: str) -> str:
    return text.lower()


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+(?=\s|\Z)|\n", text) if s.strip()]


def words(parts: list[str]) -> list[list[str]]:
    """The units of each sentence as strings, as units_of() cuts them."""
    raw = [b" " + fold(x).replace(START, "*").encode() for x in parts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = b"".join(raw) + b" "
    sym = SYMBOLS[np.frombuffer(data, np.uint8)]
    s, e, _ = units_of(sym, offsets)
    out: list[list[str]] = [[] for _ in parts]
    for k, a, b in zip((np.searchsorted(offsets, s, "right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
        w = data[a:b].decode("utf-8", "ignore")
        w = START + w[1:] if w[:1].isspace() else w
        out[k].append((w[:-1] + START if w[-1:].isspace() else w).replace(" ", "\x00"))
    return out


def fragments(word: str) -> set[str]:
    w = "".join(c for c in word if c.isalnum() or c == START)
    return {w[i : i + n] for n in (4, 5, 6, 8) for i in range(max(0, len(w) - n + 1))}


def _least(toxic: int) -> int:
    """Toxic documents that must share a fragment."""
    return max(2, round(0.02 * toxic))


def choose_landmarks(toxic: list[set[str]], clean: Counter, n_clean: int, most: int) -> list[str]:
    """Fragments that tell toxic documents from clean ones, greedily until each toxic one has COVERS of them."""
    df = Counter(f for d in toxic for f in d)
    least = _least(len(toxic))
    rate = {f: (clean[f] / max(1, n_clean)) / (n / len(toxic)) for f, n in df.items() if n >= least}
    good = {f for f, r in rate.items() if r <= 0.12}
    left = [d & good for d in toxic]
    need = [COVERS] * len(toxic)
    gain = Counter(f for d in left for f in d)
    out: list[str] = []
    while len(out) < most:
        best = max(gain, key=lambda f: (gain[f] * (1 - 5 * rate[f]), len(f), f), default=None)
        if best is None or gain[best] < least:
            break
        out.append(best)
        for i, d in enumerate(left):
            if need[i] and best in d:
                need[i] -= 1
                if need[i]:
                    gone = {f for f in d if f in best or best in f}  # what says the same counts once
                    gain.subtract(gone)
                    d -= gone
                else:
                    gain.subtract(d)
        del gain[best]
    return out


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, bias: float = -1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps with halving; y is -1 or 1, c a row's cost.

    The bias is fixed, so that a unit without a landmark's subsequences is clean by a margin.
    """

    def loss(w):
        return w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w + bias)) ** 2).sum()

    w, best = np.zeros(x.shape[1]), np.inf
    for _ in range(rounds):
        inside = y * (x @ w + bias) < 1
        xi, ci = x[inside], c[inside]
        step = np.linalg.solve(np.eye(len(w)) + 2 * xi.T @ (xi * ci[:, None]), 2 * xi.T @ (ci * (y[inside] - bias))) - w
        size = 1.0
        while (now := loss(w + size * step)) > loss(w) and size > 1e-3:
            size /= 2
        w = w + size * step
        if best - now < 1e-6 * abs(now):
            break
        best = now
    return w


def spaced(word: str) -> list[str]:
    """A word with gaps: what an insult looks like when it hides."""
    return [START + x for x in ("-".join(word), "\x00".join(word), word[: len(word) // 2] + "*" + word[len(word) // 2 :], word[:2] + "_" + word[2:])]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (offset last) of a logistic regression with smoothed targets, classes weighted alike."""
    n1, n0 = int(y.sum()), int((~y).sum())
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.ones(len(y))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (t - p)) - ridge @ w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model["logit"][:-1] + model["logit"][-1], -30, 30)))


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> dict:
    """The model of labelled texts: a weight per subsequence, the bias, and the calibration."""
    none = {"w": np.zeros(64**3, np.float32), "bias": -1.0, "logit": np.array([0.0] * 4 + [-30.0]), "landmarks": []}
    toxic = sorted({t for t, y in rows if y})  # copies tell nothing new
    clean = sorted({t for t, y in rows if not y})
    if not toxic or not clean:
        return none
    cut_toxic = [words(sentences(t)) for t in toxic]
    # fragments are counted by hash first: only those of several toxic documents are kept as strings
    held = [np.fromiter(map(hash, set().union(*(fragments(w) for s in d for w in s))), np.int64) for d in cut_toxic]
    kinds, counts = np.unique(np.concatenate(held), return_counts=True)
    often = set(kinds[counts >= _least(len(toxic))].tolist())
    del held, kinds, counts
    toxic_df = [{sys.intern(f) for s in d for w in s for f in fragments(w) if hash(f) in often} for d in cut_toxic]
    clean_words: Counter = Counter()
    clean_df: Counter = Counter()
    for t in clean:
        here = Counter(w for s in words(sentences(t)) for w in s)
        clean_words.update(here)
        clean_df.update({f for w in here for f in fragments(w) if hash(f) in often})
    marks = choose_landmarks(toxic_df, clean_df, len(clean), landmarks * 2 // 3)
    if not marks:
        return none
    found = set(marks)
    positive: Counter = Counter()
    for d in cut_toxic:
        for s in d:
            for w in s:
                if not found.isdisjoint(fragments(w)):
                    positive[w] += 1
    common = [w for w, _ in clean_words.most_common(4000) if len(w) >= 4]
    marks = [*marks, *common[: landmarks - len(marks)]]
    m = len(marks)
    unit, code, w = phi(marks)
    used, row = np.unique(code, return_inverse=True)
    grid = np.zeros((len(used), m))
    np.add.at(grid, (row, unit), w)
    grid /= np.sqrt(np.maximum((grid**2).sum(0), 1e-12))
    values, vectors = np.linalg.eigh(grid.T @ grid)
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])  # features = kernel with landmarks @ nystrom
    pos = [*positive, *(g for w in positive for g in spaced("".join(c for c in w if c.isalnum())[:10]))]
    every = [w for w in clean_words if w not in positive]
    order = np.random.default_rng(7).permutation(len(every))
    neg = [*common[:1500], *(every[i] for i in order[:6000])]
    kp, pool = kernel(pos, used, grid) @ nystrom, [every[i] for i in order[:POOL]]
    kpool = kernel(pool, used, grid)
    real = np.concatenate([np.ones(len(positive)), np.full(len(pos) - len(positive), 0.05)])  # gapped copies weigh less
    hard: set[str] = set()
    for _ in range(4):
        negatives = [*neg, *hard]
        x = np.vstack([kp, kernel(negatives, used, grid) @ nystrom])
        y = np.concatenate([np.ones(len(kp)), -np.ones(len(negatives))])
        c = COST * np.concatenate([real * min(50, len(negatives) / len(real)), [clean_words[w] ** 0.5 for w in negatives]])
        v = svm(x, y, c)
        weight = np.zeros(64**3, np.float32)
        weight[used] = grid @ (nystrom @ v)
        f = kpool @ (nystrom @ v) - 1
        bad = np.flatnonzero(f > -0.9)
        fresh = {pool[i] for i in bad[np.argsort(-f[bad])][:3000]} - hard
        if not fresh:
            break
        hard |= fresh
    model = none | {"w": weight, "landmarks": marks}
    raw = [t.encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    x = np.concatenate([decisions(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model) for i, j in pieces(offsets, 1 << 18)])
    y = np.array([bool(y) for _, y in rows])
    use = np.array([True] * 4)
    while True:  # a toxic unit must never make a text look cleaner: what would weigh against it is left out
        w = np.zeros(5)
        w[np.append(use, True)] = logistic(x[:, use], y)
        wrong = use & (w[:4] < 0) & [True, True, True, False]
        if not wrong.any():
            return model | {"logit": w}
        use[int(np.argmin(np.where(wrong, w[:4], np.inf)))] = False


def fit_apart(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> dict:
    """fit() in a process of its own, whose memory goes with it: the driver keeps the model alone. Strings hash alike each time."""
    code = "import pickle, sys; from vetstone.llm.op01_toxicity import fit; sys.stdout.buffer.write(pickle.dumps(fit(*pickle.load(sys.stdin.buffer))))"
    home = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONHASHSEED": "0", "PYTHONPATH": os.pathsep.join(x for x in (home, os.environ.get("PYTHONPATH")) if x)}
    done = subprocess.run([sys.executable, "-c", code], input=pickle.dumps((rows, landmarks)), stdout=subprocess.PIPE, env=env, check=True)
    return pickle.loads(done.stdout)


def decisions(raw: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """Per text: the highest decision among its units, LOW at least, and logarithms of how many are
    toxic, of the sum of their decisions, and of how many units there are."""
    docs = len(offsets) - 1
    raw = np.append(np.insert(raw, offsets[:-1], 32), np.uint8(32))
    offsets = offsets + np.arange(docs + 1)
    sym = SYMBOLS[raw]
    sym[raw == ord(START)] = GAP
    out = np.zeros((docs, 4))
    out[:, 0] = LOW
    out[:, 3] = np.log(SHORT)
    start, end, word_end = units_of(sym, offsets)
    if not len(start):
        return out
    n = len(sym)
    stop = np.zeros(n + 1, np.int64)  # the end of the word around each place
    begin = sym[start] == EDGE
    word_start, ends = start[begin], word_end[begin]
    room = np.zeros(n, np.int16)
    np.add.at(stop, word_start, 1)
    which = np.cumsum(stop[:-1]) - 1
    reach = ends[np.maximum(which, 0)] - np.arange(n)
    reach[which < 0] = 0
    room = np.clip(reach, 0, SPAN).astype(np.int8)
    letter = np.where(sym > GAP, sym, 0).astype(np.int32)
    padded = np.concatenate([letter, np.zeros(SPAN, np.int32)])
    first, acc, norm = padded[:n] << 12, np.zeros(n, np.float32), np.zeros(n, np.float32)
    weights = model["w"]
    on = np.flatnonzero((room > 2) & (letter > 0))
    first, room, acc_on, norm_on = first[on], room[on], np.zeros(len(on), np.float32), np.zeros(len(on), np.float32)
    shifted = [padded[on + k] for k in range(SPAN)]
    for a, b in _PAIRS:
        code = first | (shifted[a] << 6)
        code |= shifted[b]
        x = weights[code]
        x *= np.float32(LAMBDA ** (b + 1))
        inside = room > b
        x *= inside
        acc_on += x
        inside &= shifted[a] > 0
        inside &= shifted[b] > 0
        norm_on += inside * np.float32(LAMBDA ** (2 * b + 2))
    acc[on] = acc_on
    norm[on] = norm_on
    total = np.concatenate([[0.0], np.cumsum(acc, dtype=np.float64)])
    # the white space after a word begins the next word's subsequences, not this one's
    squares = np.concatenate([[0.0], np.cumsum(norm, dtype=np.float64)])
    stop = np.minimum(end, word_end - 1)
    f = (total[stop] - total[start]) / np.sqrt(np.maximum(squares[stop] - squares[start], 1e-9)) + model["bias"]
    doc = np.searchsorted(offsets, start, "right") - 1
    np.maximum.at(out[:, 0], doc, f)  # no lower than LOW, as an empty text has
    out[:, 1] = np.log1p(np.bincount(doc, f > 0, docs))
    out[:, 2] = np.log1p(np.bincount(doc, np.maximum(f, 0), docs))
    out[:, 3] = np.log(np.maximum(np.bincount(doc, minlength=docs), SHORT))
    return out


def _cleared(w: np.ndarray) -> np.ndarray:
    """No weight for subsequences with a gap or white space in them."""
    code = np.arange(64**3)
    none = ((code >> 12) < 2) | ((code >> 6 & 63) < 2) | ((code & 63) < 2)
    return np.where(none, 0, w).astype(np.float32)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> dict:
    """Fits on at most `sample` labelled documents of either class outside the held-out fold."""
    marks = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("y"))
    drawn = None
    for y in (0, 1):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
        drawn = some if drawn is None else drawn.union(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").dropDuplicates(["doc_id", "y"]).collect()
    return fit_apart([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.y))], landmarks)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score (0 to 1) to the columns doc_id and text."""
    w, rest = _cleared(model["w"]), {k: v for k, v in model.items() if k not in ("w", "landmarks")}
    shared = docs.sparkSession.sparkContext.broadcast(w)  # 64**3 floats: 1 MB at any size of the corpus
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = rest | {"w": shared.value}
        for b in batches:
            raw, offsets = string_buffers(b.column(1))
            f = [decisions(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], local) for i, j in pieces(offsets)]
            score = score_of(np.concatenate(f), local) if f else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least the threshold; all columns stay. One pass, no join."""
    w, rest = _cleared(model["w"]), {k: v for k, v in model.items() if k not in ("w", "landmarks")}
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = rest | {"w": shared.value}
        for b in batches:
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            f = [decisions(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], local) for i, j in pieces(offsets)]
            score = score_of(np.concatenate(f), local) if f else np.empty(0)
            yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
