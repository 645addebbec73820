"""Suffix-array dedup with deep-shallow sorting.

Suffixes that start at sampled anchors are sorted, on both sides of the anchor: the text to its right and, reversed,
the text to its left. The sort is multikey quicksort in 8-byte digits to a shallow depth (breadth-first: only ties are
refined), after which blind tries order the groups that still tie, whose common prefixes are long. Two places share a
window that reaches `o` bytes left of the anchor if their right suffixes share width - o bytes and their left ones o,
which the longest-common-prefix arrays of the two sorted lists tell for all places at once.

A byte goes if a string of `width` bytes over it also starts earlier: in a smaller doc_id, or earlier in the same
document; matches never cross documents and are judged on the input. Rows that share a doc_id lie on top of each other
for that test (only starts before their own count) and get a row each; a null doc_id counts as the smallest; null text
is empty; very long texts are taken whole, one at a time, with some tens of bytes of working memory a byte; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm import repeats as R
from vetstone.llm.common import Prefix, id_back, keyed, longs, pieces, string_buffers, table, whole_groups

WIDTH = 100
#: Bytes of an anchor; each window of WIDTH bytes keeps the least of its WIDTH - ANCHOR + 1.
ANCHOR = 24
#: Different contents of one anchor beyond which windows are compared by two 64-bit hashes, spread over tasks.
HOT = 4096
#: Bytes of undecided spans that are cut from a batch's texts at once.
COLD = 1 << 22
#: 8-byte digits that multikey quicksort looks at before blind tries take over.
SHALLOW = 5


class BlindTrie:
    """Orders equal-length strings: branches are stored with the byte they turn on, skipped bytes are not."""

    def __init__(self) -> None:
        self.root: list | None = None  # [depth, {byte: child}, a string below] or (string, [ids])

    def insert(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = (s, [i])
            return
        node = self.root
        while type(node) is list:  # blind descent: only the branching bytes are compared
            node = node[1].get(s[node[0]]) or node[2]
        other = node[0]
        if s == other:
            node[1].append(i)
            return
        n = len(s)
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = n - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while type(node) is list and node[0] < depth:
            parent, node = node, node[1].get(s[node[0]])
        leaf = (s, [i])
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = leaf
        else:
            new = [depth, {s[depth]: leaf, other[depth]: node}, leaf]
            if parent is None:
                self.root = new
            else:
                parent[1][s[parent[0]]] = new

    def ids(self) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                out += node[1]
            else:
                todo += [node[1][x] for x in sorted(node[1], reverse=True)]
        return out


def deep_shallow(m: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each row in that order with the one before."""
    n, width = m.shape
    if not n or not width:  # no width: nothing stands left of any anchor
        return np.arange(n), np.zeros(n, np.int64)
    digits = np.zeros((n, -(-width // 8) * 8), np.uint8)
    digits[:, :width] = m
    digits = digits.view(">u8")
    order, segment = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places in the order whose rows still tie with a neighbour
    for k in range(min(shallow, digits.shape[1])):
        rows = order[tied]
        x = digits[rows, k].astype(np.uint64)
        o = np.lexsort((x, segment[tied]))
        order[tied] = rows[o]
        x, g = x[o], segment[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        segment[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    if len(tied):
        g = segment[tied]
        cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        text = m.tobytes()
        for lo, hi in zip(cuts, np.append(cuts[1:], len(tied)), strict=True):
            trie = BlindTrie()
            for i in (rows := order[tied[lo:hi]].tolist()):
                trie.insert(text[i * width : (i + 1) * width], i)
            order[tied[lo:hi]] = trie.ids()
            del rows
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 16):
        a, b = m[order[i - 1 : i - 1 + (1 << 16)]], m[order[i : i + (1 << 16)]]
        differ = a[: len(b)] != b
        lcp[i : i + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def repeats_around(text: np.ndarray, offsets: np.ndarray, d: np.ndarray, th: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among spans with equal anchors (whole groups): (d, th, p) of the windows that also start earlier.

    text, offsets: the bytes of each span, from its first window's start to its last one's end.
    """
    s, n, off = R.unpack(p)
    at = s + off
    o = np.lexsort((at, d))
    d, s, n, off, th, at = (x[o] for x in (d, s, n, off, th, at))
    begin, size = offsets[:-1][o], np.diff(offsets)[o]
    sides = []
    for here, room in ((begin + off, size - off), (begin + off - 1, off)):
        step = 1 if not sides else -1
        deep = int(room.max(initial=0))
        cols = np.arange(deep)
        m = np.zeros((len(o), deep), np.uint8)
        for i in range(0, len(o), 1 << 15):
            inside = cols < room[i : i + (1 << 15), None]
            place = np.where(inside, here[i : i + (1 << 15), None] + step * cols, 0)
            m[i : i + (1 << 15)] = np.where(inside, text[place], 0)
        sides.append(deep_shallow(m))
    (right, right_lcp), (left, left_lcp) = sides
    rank = np.empty(len(o), np.int64)
    items, reach = [], []
    for k in range(int((off - n + 1).min()), int(off.max()) + 1):
        here = np.flatnonzero((off - n < k) & (k <= off))
        if len(here) < 2:
            continue
        rank[right] = np.cumsum(right_lcp < width - k)
        key = rank[here] * len(o)
        rank[left] = np.cumsum(left_lcp < k)
        key += rank[here]
        by = np.argsort(key, kind="stable")
        key = key[by]
        again = np.zeros(len(by), bool)
        again[1:] = key[1:] == key[:-1]
        head = here[by[np.flatnonzero(~again)[np.cumsum(~again) - 1]]]
        hit = here[by]
        again &= (d[hit] != d[head]) | (at[hit] != at[head])
        items.append(hit[again])
        reach.append(np.full(again.sum(), k))
    if not items or not sum(map(len, items)):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    item, reach = np.concatenate(items), np.concatenate(reach)
    by = np.lexsort((-reach, item))
    item, start = item[by], (at[item] - reach)[by]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return d[item[first]], th[item[first]], R.found(R.pack(start[first], np.diff(np.append(first, len(item))), 0))


def sequence(raw: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[Prefix, np.ndarray, np.ndarray]:
    return Prefix(raw, which), offsets[:-1], offsets[1:]


def repeated_windows(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(d, th, p): windows of `width` bytes that also start earlier. docs: as keyed() makes them."""
    first = R.decide(R.spans_of_docs(docs, sequence, width, anchor, True), True, hot)
    asked = R.with_text(docs, first, "inner", "k", "p", "q")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, th = longs(b, "d"), longs(b, "th")
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            row, (k, p, q) = R.row_lists(b, "k", "p", "q")
            done = q == 0
            yield with_bytes(R.batch_of(R.spread(d[row[done]], th[row[done]], p[done]), np.zeros(done.sum(), np.int64), d[row[done]], th[row[done]], p[done]))
            cold = np.flatnonzero(q == 1)
            s, n, _ = R.unpack(p[cold])
            begin = offsets[row[cold]] + s
            size = n + width - 1
            for i, j in pieces(np.concatenate([[0], np.cumsum(size)]), COLD):
                part = cold[i:j]
                to = np.concatenate([[0], np.cumsum(size[i:j])])
                data = raw[np.repeat(begin[i:j] - to[:-1], size[i:j]) + np.arange(to[-1])]
                x = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])
                yield R.batch_of(k[part], np.zeros(len(part), np.int64), d[row[part]], th[row[part]], p[part], x)
            warm = np.flatnonzero(q == 2)
            o = warm[np.argsort(row[warm], kind="stable")]
            for i, j in pieces(offsets) if len(o) else ():
                part = o[slice(*np.searchsorted(row[o], (i, j)))]
                if not len(part):
                    continue
                text = raw[offsets[i] : offsets[j]]
                s, n, _ = R.unpack(p[part])
                r = np.repeat(row[part], n)
                w = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                g = offsets[r] - offsets[i] + w
                one, two = (Prefix(text, y).slices(g, g + width).view(np.int64) for y in (0, 1))
                yield with_bytes(R.combined(one, two, d[r], th[r], R.pack(w, 1, 0), True))

    def with_bytes(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], [*b.schema.names, "x"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "k"):
            k, c, d, th, p = (longs(t, x) for x in ("k", "c", "d", "th", "p"))
            x = t.column("x").combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            text_here = x.is_valid().to_numpy(zero_copy_only=False)
            known = p < 0
            yield out(d[known], th[known], p[known])
            by_hash = np.flatnonzero(~known & ~text_here)
            o, later = R.earliest(k[by_hash], c[by_hash], d[by_hash], p[by_hash], True)
            o = by_hash[o[later]]
            yield out(d[o], th[o], R.found(p[o]))
            if text_here.any():
                raw, offsets = string_buffers(x.filter(pa.array(text_here)))
                yield out(*repeats_around(raw, offsets, d[text_here], th[text_here], p[text_here], width))

    def out(d, th, p):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(p)], ["d", "th", "p"])

    return R.grouped(asked.mapInArrow(extend, R.ROWS + ", x binary")).mapInArrow(settle, "d long, th long, p long")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    docs = keyed(docs)
    hit = R.with_text(docs, repeated_windows(docs, width), "left", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            row, (p,) = R.row_lists(b, "p")
            s, n, _ = R.unpack(-p - 1)
            o = np.argsort(row, kind="stable")
            row, s, n = row[o], s[o], n[o]
            removed, runs, kept = [], [], []
            for i, j in pieces(offsets):
                at = offsets[i : j + 1] - offsets[i]
                lo, hi = np.searchsorted(row, (i, j))
                text = raw[offsets[i] : offsets[j]]
                gone = R.covered(s[lo:hi], s[lo:hi] + n[lo:hi] + width - 1, row[lo:hi] - i, at, len(text))
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                edge = at[:-1][at[:-1] < len(gone)]
                start[edge] = gone[edge]
                total = np.concatenate([[0], np.cumsum(gone)])
                starts = np.concatenate([[0], np.cumsum(start)])
                removed += np.diff(total[at]).tolist()
                runs += np.diff(starts[at]).tolist()
                left = text[~gone].tobytes()
                ends = at - total[at]
                kept += [left[ends[x] : ends[x + 1]] for x in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("d")), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["d", "n_bytes", "n_removed", "n_spans", "kept"])

    return hit.mapInArrow(run, "d long, n_bytes long, n_removed long, n_spans long, kept binary").select(id_back().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
