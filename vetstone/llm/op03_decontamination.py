"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words (runs of non-space characters) become template tokens: numbers, units after numbers, and names (capitalised
words, also those that begin a sentence, where a name can stand) are replaced by typed placeholders, the rest is
lower-cased and stripped of punctuation. Windows of `WINDOW` tokens of the benchmark are joined by hash with those of
all documents. Where a document and an item meet at one distance, the placeholders' values are compared: a
re-parameterised question fills its names and units consistently, one here for one there, in more than `AGREE` of their
places; numbers are free, for different ones may become equal by chance. An item is leaked into a document if windows at
consistent places cover at least `COVER` of its tokens, or `RUN` tokens at one distance.

Windows of fewer than `LITERALS` literal tokens match anything. Items that the other windows cover to less than `COVER`
(of numbers and names for the most part) are searched for word by word instead, with their values: verbatim leaks are
found, re-parameterised ones can't be told from other text. Items of fewer than `LITERALS` tokens can't be searched for.
An item shorter than a window is one window of its own length. The benchmark's windows and items are broadcast up to
`SMALL` of them, beyond that joined by shuffle.

Null text is empty and matches nothing; null item ids are items like others; repeated rows are found each. Rows that
share a doc_id are told apart by their text. Very long texts are taken whole: their tokens are one array. Extra columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import NULL_ID, cut, id_back, table

WINDOW = 8
LITERALS = 4
COVER = 0.5
RUN = 32
AGREE = 2 / 3
SMALL = 200_000
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml s ms min h hr hrs hour hours day days week weeks month months year years percent % usd eur dollars euros cents dollar euro meter meters metre metres kilometers miles mile feet inches inch litre litres liter liters gallons gallon kilograms grams pounds pound minutes minute seconds second degrees degree".split()
NUMBER, UNIT, NAME = "⟨n⟩", "⟨u⟩", "⟨name⟩"


def marked(text: Column) -> Column:
    """The text with placeholders in place, word for word. Whole-text expressions, as they are cheaper than one a word."""
    text = F.translate(text, "⟨⟩", "")
    text = F.regexp_replace(text, "(?<![\\p{L}\\p{N}])\\p{Lu}\\p{L}*\\p{Ll}(?![\\p{L}\\p{N}])", NAME)
    text = F.regexp_replace(text, "[\\p{L}$€£#+-]*[0-9][\\p{L}\\p{N}.,:/-]*", NUMBER)
    return F.lower(text)


def tokens(text: Column) -> Column:
    """Template tokens, one per word of the text (empty for words of punctuation alone)."""
    plain = F.regexp_replace(marked(text), "[^\\p{L}\\p{N}\\s%⟨⟩]", "")
    words = F.split(F.regexp_replace(plain, "⟨n⟩ (%s)(?=\\s|$)" % "|".join(UNITS), f"{NUMBER} {UNIT}"), "\\s+")
    return F.filter(words, lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """The words behind tokens(), in lower case and in step with them: those that leave a token."""
    plain = F.lower(F.regexp_replace(F.translate(text, "⟨⟩", ""), "[^\\p{L}\\p{N}\\s%]", ""))
    return F.filter(F.split(plain, "\\s+"), lambda w: w != "")


def literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda w: ~w.isin(NUMBER, UNIT, NAME)))


def windows(by: str, length: int) -> Column:
    """Hashes of all windows of `length` tokens (by = tok) or words (by = raw)."""
    n = F.size(by) - length + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(by, i, length), F.lit(by)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, cover: float = COVER) -> tuple[DataFrame, DataFrame, list[tuple[int, str]]]:
    """Items (item, tok, raw), their windows (w, item, at, length, by), and the lengths in use with what is hashed: tok or raw."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text.alias("text")).distinct()
    items = cut(items.select("item", tokens(F.col("text")).alias("tok"), raw_tokens(F.col("text")).alias("raw")).where(F.size("tok") > 0))
    length = F.least(F.size("tok"), F.lit(WINDOW))
    at = F.sequence(F.lit(1), F.size("tok") - length + 1)
    telling = F.filter(at, lambda i: literals(F.slice("tok", i, length)) >= LITERALS)
    reached = F.size(F.array_distinct(F.flatten(F.transform(telling, lambda i: F.sequence(i, i + length - 1)))))
    plain = reached < cover * F.size("tok")
    rows = items.select("item", "tok", "raw", length.alias("length"), F.when(plain, "raw").otherwise("tok").alias("by"), F.explode(F.when(plain, at).otherwise(telling)).alias("at"))
    window = F.when(F.col("by") == "raw", F.slice("raw", F.col("at"), F.col("length"))).otherwise(F.slice("tok", F.col("at"), F.col("length")))
    rows = cut(rows.where(F.col("length") >= LITERALS).select(F.xxhash64(window, F.col("by")).alias("w"), "item", "at", "length", "by"))
    used = sorted((r.length, r.by) for r in rows.select("length", "by").distinct().collect())  # at most 2 WINDOW rows
    return items, rows, used


def _agreeing(pairs: Column, a: str, b: str) -> Column:
    """Places whose value `b` is the most frequent one beside their value `a`."""
    there = F.array_distinct(F.transform(pairs, lambda p: p[a]))

    def most(x: Column) -> Column:
        mine = F.transform(F.filter(pairs, lambda p: p[a] == x), lambda p: p[b])
        return F.array_max(F.transform(F.array_distinct(mine), lambda y: F.size(F.filter(mine, lambda z: z == y))))

    return F.aggregate(there, F.lit(0), lambda acc, x: acc + most(x))


def leaks(docs: DataFrame, items: DataFrame, cover: float = COVER, run: int = RUN) -> DataFrame:
    """One row per document and leaked item: d, x, item_id, n_windows, coverage, kind (verbatim or re-parameterised)."""
    items, bench, used = benchmark_windows(items, cover)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("x"), text.alias("text"))
    both = {"tok": tokens(F.col("text")).alias("tok"), "raw": raw_tokens(F.col("text")).alias("raw")}
    needed = [both[by] for by in both if any(x == by for _, x in used)]
    each = rows.select("d", "x", *needed)
    hashes = each.select("d", "x", F.explode(F.concat(F.array().cast("array<bigint>"), *(windows(by, n) for n, by in used))).alias("w"))
    known = bench.select("w").distinct()
    small = bench.count() <= SMALL and items.count() <= SMALL
    hits = hashes.join(F.broadcast(known) if small else known, "w", "left_semi").select("d", "x").distinct()
    # few documents are left: their windows once more, with places, against the items
    left = cut(rows.join(hits, ["d", "x"]).dropDuplicates(["d", "x"]).select("d", "x", both["tok"], both["raw"]))
    placed = left.select("d", "x", F.lit(0).alias("p"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("length"), F.lit("").alias("by")).limit(0)
    for n, by in used:
        placed = placed.union(left.select("d", "x", F.posexplode(windows(by, n)).alias("p", "w"), F.lit(n).alias("length"), F.lit(by).alias("by")))
    bench = F.broadcast(bench) if small else bench
    met = placed.join(bench, ["w", "length", "by"]).withColumn("shift", F.col("p") + 1 - F.col("at"))
    runs = met.groupBy("d", "x", "item", "shift").agg(F.collect_set(F.struct("at", "length")).alias("ats"))
    runs = runs.select("d", "x", "item", "shift", "ats", F.array_distinct(F.flatten(F.transform("ats", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))).alias("places"))
    # slots: the values behind placeholders, there and here
    there = items.select("item", F.col("tok").alias("itok"), F.col("raw").alias("iraw"))
    full = runs.join(left.select("d", "x", "raw"), ["d", "x"]).join(F.broadcast(there) if small else there, "item")
    slots = F.filter("places", lambda i: F.get("itok", i - 1).isin(NUMBER, UNIT, NAME))
    pairs = F.transform(slots, lambda i: F.struct(F.get("itok", i - 1).alias("kind"), F.get("iraw", i - 1).alias("a"), F.get("raw", i - 1 + F.col("shift")).alias("b")))
    full = full.select("d", "x", "item", "ats", "places", F.size("itok").alias("n"), pairs.alias("pairs"))
    full = full.withColumn("named", F.filter("pairs", lambda p: (p["kind"] != NUMBER) & p["b"].isNotNull()))
    enough = AGREE * F.size("named") + 1e-9
    full = full.where((F.size("named") == 0) | (_agreeing(F.col("named"), "a", "b") > enough) & (_agreeing(F.col("named"), "b", "a") > enough))
    full = full.withColumn("same", F.forall("pairs", lambda p: p["a"].eqNullSafe(p["b"])))
    found = full.groupBy("d", "x", "item").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.max(F.size("places")).alias("run"),
        F.sum(F.size("ats")).alias("n_windows"),
        F.max("n").alias("n"),
        F.min("same").alias("same"),
    )
    coverage = F.size("places") / F.col("n")
    leaked = found.where((coverage >= cover) | (F.col("run") >= run))
    return leaked.select("d", "x", F.col("item").alias("item_id"), "n_windows", F.round(coverage, 4).alias("coverage"), F.when(F.col("same"), "verbatim").otherwise("re-parameterised").alias("kind"))


def decontaminated(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """docs without the rows into which an item has leaked; all columns stay."""
    names = docs.columns
    bad = leaks(docs, items, cover).select(F.col("d").alias("__d"), F.col("x").alias("__x")).distinct()
    out = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__x": F.xxhash64(F.coalesce("text", F.lit("")))})
    return out.join(bad, ["__d", "__x"], "left_anti").select(*names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(id_back().alias("doc_id"), "item_id", F.col("n_windows").cast("long").alias("n_windows"), "coverage", "kind")
