"""Best-fit packing by the linear grouping scheme.

Documents become token ids; those longer than a sequence are cut. The rest is decided on the histogram of lengths,
which has at most `capacity` entries however many documents there are:

1. large lengths (over `small` of the capacity), sorted, are divided into `groups` groups of equal cardinality and each
   is rounded up to its group's largest;
2. with few sizes left, the best mix of configurations (what may share a sequence) is found by linear programming with
   column generation, rounded down to whole sequences;
3. actual documents are substituted for the rounded ones, which leaves room;
4. the large ones left over by rounding, then small ones, are put best-fit, longest first, a whole length at a time.

The outcome is a table of runs (length, first rank, place); each piece finds its place by its rank among the pieces of
its length. Ranks are counted in salted buckets, so that a frequent length is no single task's work.

Null text is empty: one token. Very long texts are tokenised whole and cut into pieces. Ties of length are settled by rank. Rows are packed as they come, repeated rows and null ids too (a null id stays null).
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetstone.llm.common import cut, table
from vetstone.llm.tokens import encoder

CAPACITY = 2048
GROUPS = 400
#: Part of the capacity up to which a length is small.
SMALL = 1 / 3
#: Pieces of one length that are ranked together.
BUCKET = 50_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, extra: list[str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if k == 0 else capacity
                    for column, v in zip(out, (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True):
                        column.append(v)
                    at, k = at + length, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped_sizes(hist: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded size, [[length, count], ...] longest first) of groups of equal cardinality."""
    total = sum(hist.values())
    if not total:
        return []
    size = -(-total // groups)
    out, here, room = [], [], size
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            take = min(n, room)
            here.append([length, take])
            n, room = n - take, room - take
            if not room:
                out.append((here[0][0], here))
                here, room = [], size
    if here:
        out.append((here[0][0], here))
    merged: list[tuple[int, list[list[int]]]] = []
    for s, members in out:  # groups rounded to one size are one
        if merged and merged[-1][0] == s:
            merged[-1][1].extend(members)
        else:
            merged.append((s, members))
    return merged


def best_column(sizes: np.ndarray, worth: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took: list[np.ndarray] = []
    for s, w, n in zip(sizes, worth, demand, strict=True):
        count = np.zeros(capacity + 1, np.int64)
        if w > 1e-12:
            base = best.copy()
            for c in range(1, int(min(capacity // s, n)) + 1):
                better = base[: capacity + 1 - c * s] + c * w
                old = best[c * s :]
                up = better > old + 1e-12
                old[up] = better[up]
                count[c * s :][up] = c
        took.append(count)
    room, column = capacity, np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        column[i] = took[i][room]
        room -= column[i] * sizes[i]
    return best[capacity], column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences get each, rounded down: revised simplex with generated columns."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = best_column(sizes, prices, demand, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        basis[:, leave] = column
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1 - 1e-9]


class Kinds:
    """Sequences of equal content, by the room left in them: room -> [[content as ((length, number), ...), how many]]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, {}

    def add(self, content: tuple, room: int, count: int) -> None:
        if count:
            self.by_room.setdefault(room, []).append([content, count])

    def best_fit(self, length: int, n: int) -> None:
        """Puts n pieces of one length, each where it leaves the least room; opens sequences when nothing fits."""
        while n:
            room = min((r for r in self.by_room if r >= length), default=None)
            if room is None:
                q = self.capacity // length
                self.add(((length, q),), self.capacity - q * length, n // q)
                if n % q:
                    self.add(((length, n % q),), self.capacity - n % q * length, 1)
                return
            content, count = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
            q = room // length
            whole = min(count, n // q)
            self.add((*content, (length, q)), room - q * length, whole)
            n, count = n - whole * q, count - whole
            if count and n and n < q:
                self.add((*content, (length, n)), room - n * length, 1)
                n, count = 0, count - 1
            self.add(content, room, count)


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """Runs as rows (length, first rank, number, first sequence, offset, pieces of the run in a sequence)."""
    kinds = Kinds(capacity)
    large = {n: c for n, c in hist.items() if n > small * capacity}
    left = Counter({n: c for n, c in hist.items() if n <= small * capacity})
    classes = grouped_sizes(large, groups)
    if classes:
        sizes = np.array([s for s, _ in classes])
        demand = np.array([sum(n for _, n in m) for _, m in classes])
        queues = [[list(y) for y in m][::-1] for _, m in classes]
        for column, count in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes)) for _ in range(column[g])]
            while count and slots:  # substitute actual documents, a stretch of equal ones at a time
                take, need = count, Counter(slots)
                for g in need:
                    if not queues[g]:
                        take = 0
                    elif (have := queues[g][-1][1] // need[g]) >= 1:
                        take = min(take, have)
                    else:
                        take = min(take, 1)
                if not take:
                    break
                content: Counter = Counter()
                if any(queues[g][-1][1] < need[g] for g in need):
                    for g in slots:
                        if not queues[g]:
                            continue
                        content[queues[g][-1][0]] += 1
                        queues[g][-1][1] -= 1
                        if not queues[g][-1][1]:
                            queues[g].pop()
                    take = 1
                else:
                    for g in need:
                        content[queues[g][-1][0]] += need[g]
                        queues[g][-1][1] -= need[g] * take
                        if not queues[g][-1][1]:
                            queues[g].pop()
                kinds.add(tuple(content.items()), capacity - sum(a * b for a, b in content.items()), take)
                count -= take
        for q in queues:
            for length, n in q:
                left[length] += n
    for length in sorted(left, reverse=True):
        kinds.best_fit(length, left[length])
    rank: Counter = Counter()
    rows, sequence = [], 0
    for room in sorted(kinds.by_room):
        for content, count in kinds.by_room[room]:
            at = 0
            for length, q in content:
                rows.append((length, rank[length], q * count, sequence, at, q))
                rank[length] += q * count
                at += q * length
            sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """Adds rank: 0, 1, ... among the rows of each length."""
    buckets = 1 + n // BUCKET
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("rank", F.row_number().over(inner) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, path, capacity))
    hist = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(hist, capacity, groups)
    key = runs[:, 0] * (1 << 44) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            r = runs[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            k = rank - r[:, 1]
            keep = [b.column(b.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(r[:, 3] + k // r[:, 5]), pa.array(r[:, 4] + k % r[:, 5] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows, sum(hist.values())).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
