"""MinHash near-dedup with ProbMinHash.

A document is its distinct shingles of five words (runs of bytes other than white space, unchanged; a shorter text is
one shingle), all of one weight, since links are of sets: with weights by occurrences, texts that differ in how often
they repeat a passage would escape the bands. Each shingle is a Poisson process of rate 1: its arrivals, at times drawn
from the shingle's hash alone, fall into random registers, a register keeps the shingle that arrives first, and a
process ends once its next arrival is later than every register. Two documents agree in a register with a probability
equal to the probability Jaccard similarity of their weights, here the Jaccard similarity of the sets. Registers are
banded; what meets in a band is verified by the exact Jaccard similarity of the shingle sets, 0.8 or more.

A distinct text is a node, whatever ids its rows have; equal texts are one before any banding. A bucket isn't joined
with itself at once: its nodes first try one head, the bucket's most met node, so that a large group of near copies
costs a pair for each of its members. What is then still in different components is compared in full in buckets where
a node meets few others (FULL). In larger ones, where many copies of one text may be near it but not each other, nodes
are told apart by what they gained and lost against a hub (see `differences`), rarest shingles first: that makes finer
buckets of the same kind, which are treated in the same way, and no link that a band offers is lost. Before sets are
compared, pairs go of which 256 bits of parities (see `parities`) show that they differ in too many shingles.

Returns one row per row of the input: doc_id, class_id (the least doc_id of its class). Texts without words are classes
of their own. Rows that share a doc_id are told apart by their text. A null id stays null and counts as the smallest.
Very long texts are taken whole, one at a time. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetstone.llm.common import NULL_ID, Prefix, cut, free, id_back, longs, mix, pieces, string_buffers, table
from vetstone.llm.graph import components
from vetstone.llm.op09_substring_dedup import words_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Others that a node meets in a bucket up to which they are compared pair by pair: in bands, and after a split.
FULL, SPLIT = 4, 32
#: Times that large buckets are split by differences; what is large even then is compared pair by pair, too.
LEVELS = 3


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle, with repetitions, in order."""
    start, end, first = words_of(raw, offsets)
    seq = Prefix(Prefix(raw).slices(start, end))
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, seq.slices(at, at + np.minimum(words, n)[doc])


def weighted(doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle), each of weight 1."""
    o = np.lexsort((g, doc))
    doc, g = doc[o], g[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[new], g[new], np.ones(new.sum())


def prob_minhash(doc: np.ndarray, g: np.ndarray, w: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m registers of shingle hashes."""
    times = np.full(docs * m, np.inf)
    sig = np.zeros(docs * m, np.uint64)
    alive, t = np.arange(len(g)), np.zeros(len(g))
    k, block = 0, 1
    while len(alive):
        step = np.arange(k + 1, k + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = mix(g[alive, None] + step)
        u = ((x >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40
        arrive = t[alive, None] + np.cumsum(-np.log(u) / w[alive, None], axis=1)
        slot = doc[alive, None] * m + (((x & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(times, slot.ravel(), arrive.ravel())
        first = times[slot] == arrive
        who = np.broadcast_to(g[alive, None], first.shape)
        sig[slot[first]] = who[first]
        t[alive] = arrive[:, -1]
        latest = times.reshape(docs, m).max(1)
        alive = alive[t[alive] < latest[doc[alive]]]  # early termination
        k += block
        if k > 1:
            block = min(2 * block, 64)
    return sig.reshape(docs, m)


def parities(doc: np.ndarray, g: np.ndarray, docs: int) -> np.ndarray:
    """docs x 4 words of 64 bits: shingles fall on a bit each, which says whether their number there is odd. Two sets
    differ in at least as many shingles as bits, so bits can rule a pair out but never in."""
    words = np.zeros(docs * 4, np.uint64)
    np.bitwise_xor.at(words, doc * 4 + (g >> np.uint64(62)).astype(np.int64), np.uint64(1) << ((g >> np.uint64(56)) & np.uint64(63)))
    return words.view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(d, e, bands, z, bits): e names the text, z counts its shingles, bits are their parities; no bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            out, count, bits = [], [], []
            for i, j in pieces(offsets, 1 << 21):
                doc, g, w = weighted(*shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                sig = prob_minhash(doc, g, w, j - i, bands * rows).reshape(j - i, bands, rows)
                key = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + sig[:, :, r])
                key = mix(key + np.arange(1, bands + 1, dtype=np.uint64))
                out.append(key.view(np.int64))
                count.append(np.bincount(doc, minlength=j - i))
                bits.append(parities(doc, g, j - i))
            keys, count, bits = (np.concatenate(x) for x in (out, count, bits))
            some = count > 0
            at = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            four = pa.array(np.arange(len(count) + 1, dtype=np.int32) * 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel())), pa.array(count), pa.ListArray.from_arrays(four, pa.array(bits))], ["d", "e", "bands", "z", "bits"])

    return docs.mapInArrow(run, "d long, e binary, bands array<long>, z long, bits array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(n, shingles): each document's distinct shingles as sorted 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffers(b.column(b.schema.get_field_index("text")))
            for i, j in pieces(offsets):
                doc, g, _ = weighted(*shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                at = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([g[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["n", "shingles"])

    return docs.mapInArrow(run, "n long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets' Jaccard similarity is at least the threshold."""
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(both) - common) - 1e-9


#: Rows of two node ids up to which they are broadcast to the sets, instead of all sets being shuffled to them.
SMALL = 200_000


def with_sets(rows: DataFrame, sets: DataFrame, one: str, two: str) -> DataFrame:
    """rows (two columns of nodes, checkpointed) with the sets x and y of both."""
    x, y = sets.toDF(one, "x"), sets.toDF(two, "y")
    if rows.count() > SMALL:
        return rows.join(x, one).join(y, two).select(one, two, "x", "y")
    return x.join(F.broadcast(rows), one).join(y.join(F.broadcast(rows.select(two).distinct()), two, "left_semi"), two).select(one, two, "x", "y")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b; checkpointed) whose sets' Jaccard similarity is at least the threshold."""
    both = with_sets(pairs, sets, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(b.schema.get_field_index("x")), b.column(b.schema.get_field_index("y")), strict=True):
                keep.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), threshold))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(keep) for c in "ab"], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def differences(beside: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Finer buckets for nodes n beside hubs p, and links (a, b) between the two. beside: (n, p); nodes: (n, c, z, hub), and bits if there are.

    Buckets are rows (b, n, c, z, hub, bits, p, asks, answers); of two nodes of a bucket one must ask and the other answer.
    With q = threshold / (1 + threshold), x and y are similar if they share q (|x| + |y|) shingles. A(x) is what x
    gained against p, B(x) what it lost. Of similar x and y that aren't both similar to p (x isn't, say),
    either A(x) and A(y) share something, and then at least |A(x)| - (1 - threshold) |x|, and likewise for y;
    or they share nothing there, all that x and y have in common is in p, and B(x) and B(y) share more than
    (1 - q) |B(y)| + q |A(y)|, and at least |B(x)| + q |x| - (1 - q) |y|, where |y| is at most |p|, |x| / threshold,
    and |x and p| / q - |x|.
    Of sets that share k elements the first |set| - k + 1 in any common order meet. The order is the rarest first, so
    that the shingles nobody else has, which need no row, leave little room for the common ones.
    """
    q = threshold / (1 + threshold)
    both = with_sets(beside, sets, "n", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cols = np.repeat(np.array(heads, np.int64), [len(x) for x in parts], axis=0).T
            names = ["n", "p", "kind", "total", "ask", "reply"]
            out = pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in cols), pa.array(np.concatenate(parts).view(np.int64))], [*names, "s"])
            heads.clear()
            parts.clear()
            return out

        waiting = 0
        for b in batches:
            for n, p, x, y in zip(*(b.column(b.schema.get_field_index(k)) for k in ("n", "p", "x", "y")), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                gained, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                near = len(x) - len(gained) >= threshold * (len(x) + len(lost)) - 1e-9
                some = math.floor((1 - threshold) * len(x) + 1e-6) + 1
                room = (len(x) - len(gained)) / q - len(x)  # shingles of a similar set that has nothing of `gained`
                reply = math.ceil(q * (len(lost) - len(gained)) + 1e-6)
                ask = 0 if near else math.floor((1 - q) * min(len(y), len(x) / threshold, room) - q * len(x) + 1e-6) + 1
                if room < threshold * len(x) - 1e-6:
                    ask = reply = 0
                for kind, part, asks, replies in ((0, gained, 0 if near else some, some), (1, lost, ask, reply), (2, x[:1] if near else x[:0], 0, 1)):
                    if len(part) and max(asks, replies) > 0:
                        heads.append((n.as_py(), p.as_py(), kind, len(part), min(asks, len(part)), min(replies, len(part))))
                        parts.append(part)
                        waiting += len(part)
            if waiting > 1 << 17:
                yield flush()
                waiting = 0
        if parts:
            yield flush()

    made = cut(both.mapInArrow(run, "n long, p long, kind long, total long, ask long, reply long, s long"))
    links = made.where("kind = 2").select(F.col("n").alias("a"), F.col("p").alias("b"))
    made = made.where("kind < 2")
    often = made.groupBy("p", "kind", "s").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = made.join(often, ["p", "kind", "s"])
    one = Window.partitionBy("n", "p", "kind")
    place = F.row_number().over(one.orderBy("often", "s")) + F.col("total") - F.count(F.lit(1)).over(one)
    rows = shared.withColumn("place", place).select("n", "p", F.xxhash64("p", "kind", "s").alias("b"), (F.col("place") <= F.col("ask")).alias("asks"), (F.col("place") <= F.col("reply")).alias("answers"))
    # the checkpoint keeps the join from being run again for each use of the rows
    rows = cut(rows.where("asks or answers"))
    return rows.join(nodes, "n").select("b", *nodes.columns, "p", "asks", "answers"), links


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of buckets in which nodes of more than one component ask and answer, with the number that each meets there on average."""
    split = rows.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), F.count_if("asks").alias("asking"), F.count_if("answers").alias("answering"))
    split = split.where("lo <> hi and asking > 0 and answering > 0")
    return rows.join(split.select("b", (F.col("asking") * F.col("answering") / F.col("size")).alias("load")), "b")


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket and different components that one asks and the other answers, if their sizes, and their parities if there are bits, allow a link."""
    both = ("n", "c", "z", *(x for x in rows.columns if x == "bits"))
    one, two = rows.where("asks").select("b", *(F.col(x).alias(f"{x}1") for x in (*both, "answers"))), rows.where("answers").select("b", *(F.col(x).alias(f"{x}2") for x in (*both, "asks")))
    met = one.join(two, "b").where("c1 <> c2 and (n1 < n2 or not (answers1 and asks2))").where(F.least("z1", "z2") >= threshold * F.greatest("z1", "z2"))
    if "bits" in both:
        apart = sum((F.bit_count(F.col("bits1")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(4)), F.lit(0))
        met = met.where(apart <= (1 - threshold) / (1 + threshold) * (F.col("z1") + F.col("z2")) + 1e-6)
    return met.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, full: int = FULL, split: int = SPLIT) -> DataFrame:
    """One row per row of docs: d, e (the text's MD5), c (the class, null for a text without words), least (its least d)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.unhex(F.md5(text)).alias("e"), text.alias("text"))
    sketch = cut(sketches(ids, bands, rows, words))
    # the checkpoint settles the texts' numbers
    texts = sketch.groupBy("e").agg(F.min("d").alias("d"), *(F.first(c).alias(c) for c in ("bands", "z", "bits"))).where(F.size("bands") > 0)
    texts = cut(texts.withColumn("n", F.monotonically_increasing_id()))
    met = texts.select("n", "z", F.explode("bands").alias("b"))
    met = cut(met.join(met.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "b"))
    popular = cut(met.groupBy("n", "z").agg(F.sum("size").alias("w")))
    sets = ids.join(texts.select("n", "d", "e").join(popular, "n", "left_semi"), ["d", "e"]).dropDuplicates(["d", "e"])
    sets = cut(shingle_sets(sets.select("n", "text"), words))
    free(docs.sparkSession)
    # every node tries the most met node of its buckets
    met = met.select("b", "n").join(popular, "n")
    heads = met.groupBy("b").agg(F.max_by(F.struct("n", "z", "w"), F.struct("w", F.bitwise_not(F.col("n")))).alias("h"))
    tried = cut(met.join(heads, "b").where("n <> h.n").select("n", "z", "h").distinct())
    fits = F.least("z", "h.z") >= threshold * F.greatest("z", "h.z")
    found = components(verified(cut(tried.where(fits).select(F.least("n", "h.n").alias("a"), F.greatest("n", "h.n").alias("b")).distinct()), sets, threshold))
    free(docs.sparkSession)
    # a component's hub is its most met node; a node alone has that of the most met node it met
    hubs = found.join(popular, "n").groupBy("c").agg(F.max_by("n", F.struct("w", F.bitwise_not(F.col("n")))).alias("hub"))
    found = found.join(hubs, "c").select("n", "c", "hub")
    anchor = tried.groupBy("n").agg(F.max_by("h.n", F.struct("h.w", "h.n")).alias("anchor")).join(found.select(F.col("n").alias("anchor"), F.col("hub").alias("theirs")), "anchor", "left")
    nodes = popular.join(found, "n", "left").join(anchor, "n", "left")
    nodes = nodes.join(texts.select("n", "bits"), "n")
    nodes = cut(nodes.select("n", F.coalesce("c", "n").alias("c"), "z", "bits", F.coalesce("hub", "theirs", "anchor", "n").alias("hub")))
    links = found.where("n <> c").select(F.col("n").alias("a"), F.col("c").alias("b"))
    yes, used = F.lit(True), None
    part = met.select("b", "n").join(nodes, "n").select("b", "n", "c", "z", "bits", "hub", F.lit(None).cast("long").alias("p"), yes.alias("asks"), yes.alias("answers"))
    for level in range(LEVELS + 1):
        part = cut(_apart(part))
        if part.isEmpty():
            break
        # the hub of a bucket is that of most of its nodes; if that has made the bucket, its smallest node, against which
        # little is lost
        tops = part.where(F.col("load") > (split if level else full)).groupBy("b", "hub").agg(F.count(F.lit(1)).alias("many"), F.first("p").alias("p"), F.min(F.struct("z", "n")).alias("small"))
        tops = tops.groupBy("b").agg(F.max_by("hub", F.struct("many", "hub")).alias("hub"), F.first("p").alias("p"), F.min("small").alias("small"))
        tops = tops.select("b", F.when(F.col("hub").eqNullSafe(F.col("p")), F.col("small.n")).otherwise(F.col("hub")).alias("by"))
        # a node that was a hub at an earlier level would make the same buckets again, or miss those that it was held
        # against then: such buckets are compared pair by pair
        tops = cut(tops if used is None else tops.join(used, "by", "left_anti"))
        last = level == LEVELS or tops.isEmpty()
        pairs = cut(_pairs(part if last else part.join(tops, "b", "left_anti"), threshold))
        if not pairs.isEmpty():
            links = links.union(cut(verified(pairs, sets, threshold)))
        if last:
            break
        beside = cut(part.join(tops, "b").where("n <> by").select("n", F.col("by").alias("p")).distinct())
        used = tops.select("by").distinct() if used is None else used.union(tops.select("by").distinct())
        part, more = differences(beside, nodes, sets, threshold)
        links = links.union(more)
        free(docs.sparkSession)
    found = components(links)
    label = cut(texts.select("e", "n", "d").join(found, "n", "left").select("e", "d", F.coalesce("c", "n").alias("c")))
    shared = cut(label.groupBy("c").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").select("c", "least"))
    label = label.join(shared, "c", "left").select("e", "c", F.coalesce("least", "d").alias("least"))
    return sketch.select("d", "e").join(label, "e", "left").select("d", "e", "c", F.coalesce("least", "d").alias("least"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id."""
    return classes(docs, threshold, bands, rows, words).select(id_back().alias("doc_id"), id_back("least").alias("class_id"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the least doc_id and then the least text hash; all columns stay. Of
    repeated rows one stays, and so does every different text without words."""
    names = docs.columns
    each = cut(classes(docs).where("d = least").select("d", "e", "c"))
    chosen = each.where("c is not null").groupBy("c").agg(F.min(F.struct("d", "e")).alias("row")).select("row.*")
    chosen = chosen.union(each.where("c is null").select("d", "e").distinct()).toDF("__d", "__e")
    key = {"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__e": F.unhex(F.md5(F.coalesce("text", F.lit(""))))}
    return docs.withColumns(key).join(chosen, ["__d", "__e"], "left_semi").dropDuplicates(["__d", "__e"]).select(*names)
