"""Distributed search for repeated windows, shared by the byte-level and the word-level substring operators.

A window is a run of consecutive units (bytes, words) of one document. Shipping every window through a shuffle would
cost many times the input, so windows are sampled without losing any: of the anchors (shorter runs) inside a window the
one with the least hash is kept, and consecutive windows with the same kept anchor form one span. Equal windows keep
equal anchors, hence:

1. every document yields its spans; spans go to their anchor's hash. Of spans with equal content all but the earliest
   are repeats, at once and without looking at text;
2. only spans whose anchor also occurs with other content are undecided: these are cut from the text again and
   resolved window by window.

All rows are (k, c, d, th, p): group key, content hash, document, its text's hash, packed position. A task keeps one row of each content per
batch before the shuffle, so that a passage that fills a third of the corpus costs one row per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetstone.llm.common import Prefix, longs, mix, sliding_min, string_buffers, whole_groups

ROWS = "k long, c long, d long, th long, p long"
#: Packed position: start << 29 | number of windows << 22 | anchor's offset << 15; negative: a found repeat.
S_BITS, N_BITS, O_BITS = 29, 22, 15


def pack(s, n, off) -> np.ndarray:
    i = np.int64
    return (np.asarray(s, i) << i(S_BITS)) | (np.asarray(n, i) << i(N_BITS)) | (np.asarray(off, i) << i(O_BITS))


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows, anchor's offset."""
    return p >> S_BITS, (p >> N_BITS) & 127, (p >> O_BITS) & 127


def found(p: np.ndarray) -> np.ndarray:
    """Marks positions as found repeats."""
    return -p - 1


def spans(grams: np.ndarray, seq: Prefix, doc_start: np.ndarray, doc_end: np.ndarray, width: int, k: int) -> dict[str, np.ndarray]:
    """Spans of consecutive windows of `width` units with the same least anchor of `k` units.

    grams: the hash of the anchor at each unit. doc_start, doc_end: each document's units.
    """
    n = len(seq.h) - 1
    empty = {x: np.empty(0, np.int64) for x in ("doc", "s", "n", "off", "anchor")} | {x: np.empty(0, np.uint64) for x in ("h", "c")}
    windows = n - width + 1
    if windows <= 0:
        return empty
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = grams & ~low
    order |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(order, width - k + 1)[:windows]
    least &= low
    at = least.astype(np.int64)
    ok = np.zeros(windows + 1, np.int32)
    some = doc_end - doc_start >= width
    np.add.at(ok, doc_start[some], 1)
    np.add.at(ok, doc_end[some] - width + 1, -1)
    s = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(s):
        return empty
    a = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1) | np.isin(s[1:], doc_start)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    s, a = s[first], a[first]
    off = a - s
    c = seq.slices(s, s + count + (width - 1))
    c ^= mix((off.astype(np.uint64) << np.uint64(8)) | count.astype(np.uint64))
    return {"doc": np.searchsorted(doc_start, s, "right") - 1, "s": s, "n": count, "off": off, "anchor": a, "h": grams[a], "c": c}


def batch_of(k, c, d, th, p, extra: pa.Array | None = None) -> pa.RecordBatch:
    k, c, d, th, p = (np.ascontiguousarray(x).view(np.int64) for x in (k, c, d, th, p))
    # 64 bits of k and 40 of c tell contents apart; what isn't sent compresses to nothing
    arrays = [pa.array(x) for x in (k, c & ((1 << 40) - 1), d, th, p)]
    names = ["k", "c", "d", "th", "p"]
    if extra is not None:
        arrays, names = [*arrays, extra], [*names, "x"]
    return pa.RecordBatch.from_arrays(arrays, names)


def spread(d: np.ndarray, th: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Keys for rows that no longer need company: anywhere, evenly."""
    return mix(d.view(np.uint64) ^ th.view(np.uint64) ^ (p.view(np.uint64) >> np.uint64(13))).view(np.int64)


def earliest(k, c, d, p, same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (k, c) together by position, and which rows in it repeat an earlier one.

    same_doc: an earlier start in the same document counts too.
    """
    o = np.lexsort((p, d, c, k))
    k, c, d, p = k[o], c[o], d[o], p[o]
    new = np.ones(len(o), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(o) else o
    later = d > d[head]
    if same_doc:
        later |= (d == d[head]) & ((p >> S_BITS) > (p[head] >> S_BITS))
    return o, later


def combined(k, c, d, th, p, same_doc: bool) -> pa.RecordBatch:
    """One batch's rows: those of repeats within the batch marked as found, the rest to be grouped by k."""
    o, later = earliest(k, c, d, p, same_doc)
    k, c, d, th, p = k[o], c[o], d[o], th[o], p[o]
    p = np.where(later, found(p), p)
    return batch_of(np.where(later, spread(d, th, p), k), np.where(later, 0, c), d, th, p)


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k")


def decide(rows: DataFrame, same_doc: bool, hot: int) -> DataFrame:
    """Of rows by anchor: found repeats (q = 0), and spans that need a look at the text (q = 1, or 2 if their anchor has
    over `hot` different contents, so that they are spread by window instead of meeting in one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "k"):
            k, c, d, th, p = (longs(t, x) for x in ("k", "c", "d", "th", "p"))
            known = p < 0
            yield out(k[known], d[known], th[known], p[known], np.zeros(known.sum(), np.int32))
            k, c, d, th, p = (x[~known] for x in (k, c, d, th, p))
            if not len(k):
                continue
            o, later = earliest(k, c, d, p, same_doc)
            k, c, d, th, p = k[o], c[o], d[o], th[o], p[o]
            yield out(k[later], d[later], th[later], found(p[later]), np.zeros(later.sum(), np.int32))
            group = np.ones(len(k), bool)
            group[1:] = k[1:] != k[:-1]
            content = group.copy()
            content[1:] |= c[1:] != c[:-1]
            g = np.cumsum(group) - 1
            contents = np.bincount(g, content)[g]
            open_ = ~later & (contents > 1)
            yield out(k[open_], d[open_], th[open_], p[open_], np.where(contents[open_] > hot, 2, 1).astype(np.int32))

    def out(k, d, th, p, q):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, d, th, p, q)], ["k", "d", "th", "p", "q"])

    return grouped(rows).mapInArrow(run, "k long, d long, th long, p long, q int")


def found_only(rows: DataFrame, same_doc: bool) -> DataFrame:
    """(d, th, p) of the found repeats among rows grouped by whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "k"):
            k, c, d, th, p = (longs(t, x) for x in ("k", "c", "d", "th", "p"))
            known = p < 0
            open_ = np.flatnonzero(~known)
            o, later = earliest(k[open_], c[open_], d[open_], p[open_], same_doc)
            o = open_[o[later]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[known], d[o]])), pa.array(np.concatenate([th[known], th[o]])), pa.array(np.concatenate([p[known], found(p[o])]))], ["d", "th", "p"])

    return grouped(rows).mapInArrow(run, "d long, th long, p long")


def with_text(docs: DataFrame, rows: DataFrame, how: str, *cols: str) -> DataFrame:
    """Each document that has rows (or every one, for how="left") with the list of its rows."""
    lists = rows.groupBy("d", "th").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    return docs.join(lists, ["d", "th"], how)


def row_lists(batch: pa.RecordBatch, *cols: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each list element its batch row; the elements' fields."""
    col = batch.column(batch.schema.get_field_index("rows"))
    size = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(len(col)), size), [flat.field(flat.type.get_field_index(x)).to_numpy(zero_copy_only=False) for x in cols]


def covered(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, base: np.ndarray, units: int) -> np.ndarray:
    """Which of `units` units (documents end to end, row i from base[i]) lie in one of the intervals."""
    mark = np.zeros(units + 1, np.int32)
    np.add.at(mark, base[row] + starts, 1)
    np.add.at(mark, base[row] + ends, -1)
    return np.cumsum(mark[:-1]) > 0


def spans_of_docs(docs: DataFrame, sequence: Callable, width: int, k: int, same_doc: bool) -> DataFrame:
    """Step 1's rows. sequence(raw, offsets) -> (Prefix, doc_start, doc_end) in units, for documents end to end."""
    from vetstone.llm.common import pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, th = longs(b, "d"), longs(b, "th")
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            got = []
            for i, j in pieces(offsets):
                seq, start, end = sequence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x = spans(seq.grams(k), seq, start, end, width, k)
                doc = x["doc"] + i
                got.append((x["h"].view(np.int64), x["c"].view(np.int64), d[doc], th[doc], pack(x["s"] - start[x["doc"]], x["n"], x["off"])))
            if got:
                yield combined(*(np.concatenate(y) for y in zip(*got, strict=True)), same_doc)

    return docs.mapInArrow(run, ROWS)
