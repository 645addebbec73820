"""Substring dedup by level-wise doubling over words.

Words are runs of bytes other than space and 0x09-0x0D. A window of n words can only repeat if its sub-windows of half
the length (rounded up) repeat, so level 1 looks at those alone, sampled to one anchor per window; windows around
anchors that repeat are extended to at most twice their length, n words, in level 2, and with `levels` beyond that
doubled again until no candidate survives.

A word goes if a window over it has a word sequence that also starts in a document with a smaller doc_id; windows are
judged on the input. Rows that share a doc_id are one document for that test and get a row each; a null doc_id counts
as the smallest; null text is empty; very long texts are taken whole, one at a time; extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm import repeats as R
from vetstone.llm.common import Prefix, id_back, keyed, longs, pieces, string_buffers, table

#: Different contents of one anchor beyond which its windows are spread over tasks.
HOT = 4096


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each document's first word (n+1 entries); documents lie end to end."""
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def sequence(raw: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[Prefix, np.ndarray, np.ndarray]:
    start, end, first = words_of(raw, offsets)
    return Prefix(Prefix(raw, which).slices(start, end), which), first[:-1], first[1:]


def windows(b: pa.RecordBatch, words: int, same_doc: bool = False) -> Iterator[pa.RecordBatch]:
    """Every window of the spans asked for, as rows by the window's hash; found repeats pass."""
    d, th = longs(b, "d"), longs(b, "th")
    raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
    row, (p,) = R.row_lists(b, "p")
    done = p < 0
    zero = np.zeros(done.sum(), np.int64)
    yield R.batch_of(R.spread(d[row[done]], th[row[done]], p[done]), zero, d[row[done]], th[row[done]], p[done])
    row, p = row[~done], p[~done]
    o = np.argsort(row, kind="stable")
    row, p = row[o], p[o]
    for i, j in pieces(offsets):
        lo, hi = np.searchsorted(row, (i, j))
        if lo == hi:
            continue
        text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        (one, first, _), (two, _, _) = sequence(text, at), sequence(text, at, 1)
        s, n, _ = R.unpack(p[lo:hi])
        r = np.repeat(row[lo:hi], n)
        s = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
        g = first[r - i] + s
        yield R.combined(one.slices(g, g + words).view(np.int64), two.slices(g, g + words).view(np.int64), d[r], th[r], R.pack(s, 1, 0), same_doc)


def repeated_windows(docs: DataFrame, words: int = 13) -> DataFrame:
    """(d, th, p): windows of `words` words that also start in an earlier document. docs: as keyed() makes them."""
    level1 = R.decide(R.spans_of_docs(docs, sequence, words, (words + 1) // 2, False), False, HOT)
    asked = R.with_text(docs, level1, "inner", "p")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from windows(b, words)

    return R.found_only(asked.mapInArrow(extend, R.ROWS), False)


def longest_levels(docs: DataFrame, words: int = 13, levels: int = 32) -> list[tuple[int, int]]:
    """Number of repeated windows at `words`, twice that, and so on until no candidate survives (or `levels`)."""
    from vetstone.llm.common import cut

    docs, out = keyed(docs), []
    for k in range(levels):
        n = repeated_windows(docs, words << k) if words << k <= 64 else _doubled(docs, last, words << (k - 1))
        last = cut(n)
        if not (count := last.select(F.sum(_n(F.col("p")))).first()[0] or 0):
            break
        out.append((words << k, int(count)))
    return out


def _n(p):
    return F.shiftright(-p - 1, R.N_BITS).bitwiseAND(F.lit(127))


def _doubled(docs: DataFrame, last: DataFrame, half: int) -> DataFrame:
    """Windows of twice `half` words of which both halves repeat, kept if the whole repeats."""
    each = last.select("d", "th", F.explode(F.expr(f"sequence(shiftright(-p - 1, {R.S_BITS}), shiftright(-p - 1, {R.S_BITS}) + (shiftright(-p - 1, {R.N_BITS}) & 127) - 1)")).alias("s")).distinct()
    ask = each.join(each.select("d", "th", (F.col("s") - half).alias("s")), ["d", "s", "th"]).select("d", "th", (F.shiftleft(F.col("s"), R.S_BITS) + F.lit(1 << R.N_BITS)).alias("p"))
    # the earliest copy is no found repeat itself, so candidates are compared with all windows whose halves occur
    keys = docs.mapInArrow(lambda bs: (x for b in bs for x in _all_windows(b, half * 2)), R.ROWS)
    wanted = R.with_text(docs, ask, "inner", "p").mapInArrow(lambda bs: (x for b in bs for x in windows(b, half * 2)), R.ROWS).where("p >= 0").select("k").distinct()
    return R.found_only(keys.join(wanted, "k", "left_semi"), False)


def _all_windows(b: pa.RecordBatch, words: int) -> Iterator[pa.RecordBatch]:
    d, th = longs(b, "d"), longs(b, "th")
    raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
    for i, j in pieces(offsets):
        text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        (one, first, end), (two, _, _) = sequence(text, at), sequence(text, at, 1)
        n = np.maximum(end - first - words + 1, 0)
        r = np.repeat(np.arange(i, j), n)
        s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = first[r - i] + s
        yield R.batch_of(one.slices(g, g + words), two.slices(g, g + words), d[r], th[r], R.pack(s, 1, 0))


def remove_repeats(docs: DataFrame, words: int = 13) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    docs = keyed(docs)
    hit = R.with_text(docs, repeated_windows(docs, words), "left", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            row, (p,) = R.row_lists(b, "p")
            s, n, _ = R.unpack(-p - 1)
            n_words, n_removed, kept = [], [], []
            o = np.argsort(row, kind="stable")
            row, s, n = row[o], s[o], n[o]
            for i, j in pieces(offsets):
                text = raw[offsets[i] : offsets[j]]
                start, end, first = words_of(text, offsets[i : j + 1] - offsets[i])
                lo, hi = np.searchsorted(row, (i, j))
                gone = R.covered(s[lo:hi], s[lo:hi] + n[lo:hi] + words - 1, row[lo:hi] - i, first, len(start))
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_words += np.diff(first).tolist()
                n_removed += (removed[first[1:]] - removed[first[:-1]]).tolist()
                # bytes of kept words, each followed by a space
                keep = np.zeros(len(text) + 1, np.int8)
                np.add.at(keep, start[~gone], 1)
                np.add.at(keep, end[~gone], -1)
                mask = np.cumsum(keep[:-1]) > 0
                length = np.zeros(len(text) + 1, np.int64)
                np.cumsum(mask, out=length[1:])
                left = np.bincount(np.searchsorted(first, np.flatnonzero(~gone), "right") - 1, minlength=j - i) if len(start) else np.zeros(j - i, np.int64)
                size = np.where(~gone, end - start + 1, 0)
                out = np.full(int(size.sum()), 32, np.uint8)
                to = np.cumsum(size) - size
                lengths = (end - start)[~gone]
                inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                out[np.repeat(to[~gone], lengths) + inner] = text[np.repeat(start[~gone], lengths) + inner]
                ends = np.concatenate([[0], np.cumsum(size)])[first]
                view = out.tobytes()
                kept += [view[ends[x] : max(ends[x], ends[x + 1] - 1)].decode("utf-8", "surrogateescape") if left[x] else "" for x in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("d")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["d", "n_words", "n_removed", "kept"])

    return hit.mapInArrow(run, "d long, n_words long, n_removed long, kept string").select(id_back().alias("doc_id"), "n_words", "n_removed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
bad AS (SELECT doc_id, list(s) AS ss FROM win JOIN first USING (g) WHERE d < doc_id GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM (SELECT doc_id, unnest(ss) AS s FROM bad)),
word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
