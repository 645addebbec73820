"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within `tau` edits of each other share, by the pigeonhole principle, one of tau + 1 segments, and in such a way
that no more edits stand before and after it than segments do. A line probes the substring indexes of its own length
and of the tau next shorter ones, at the few places that this allows. What meets is verified by a banded bit-parallel
edit distance: an automaton whose states for 0..tau errors are bit vectors over the 2 tau + 1 diagonals of the band.

Most segments occur in one line alone. A first pass counts segments by hash; the second one looks each line's segments
up in a bitmap of those that several lines share, of fixed size and so fit to be broadcast, and only lines that pass go
on with their text. A bucket of up to `BUCKET` lines is joined with itself. In a larger one lines meet by what is left
of them without the segment and without up to tau more characters, which any two within tau edits share: as many rows
as characters (to the power of tau), never all pairs of a hot segment.

Every line that isn't blank takes part and gets a row; equal lines are one line (named by their MD5). Lines of fewer
than `LEAST` characters, spaces around not counted, are only linked to equal ones. A line goes if an equal or a linked
one occurs earlier (smaller doc_id, then smaller line number); that is judged on the input.

Null text is empty, one blank line. Very long texts are lines like others; a very long line costs its length in the
edit distance, and in a hot bucket as many rows. Rows that share a doc_id are told apart by their text; equal rows keep
the same lines, so that repeated rows don't remove each other's. A null id counts as the smallest. Extra columns stay
where documents are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import NULL_ID, cut, id_back, sieve, table

#: Edits that make two lines alike still.
TAU = 1
#: Characters from which lines are linked to unequal ones.
LEAST = 20
BUCKET = 32


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, x, i, line) of all lines that aren't blank: x tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64(text).alias("x"),
        F.posexplode(F.split(text, "\n", -1)).alias("i", "line"),
    )
    return rows.where(F.trim("line") != "")


def segments(line: Column, tau: int) -> Column:
    """A line's own segments and its probes: (k, at, size, probe); k hashes the characters, their length's index and the segment's number.

    Segment j of a line of m characters starts at floor(j m / (tau + 1)). The same characters stand in a line that is
    `more` longer at most j places off, and, counted from the end, at most tau - j.
    """
    n, out = F.length(line), []
    for more in range(tau + 1):
        m = n - more
        for j in range(tau + 1):
            start, end = F.floor(m * j / (tau + 1)).cast("int"), F.floor(m * (j + 1) / (tau + 1)).cast("int")
            for off in range(max(-j, more - (tau - j)), min(j, more + (tau - j)) + 1):
                key = F.xxhash64(F.substring(line, start + off + 1, end - start), m, F.lit(j))
                out.append(F.struct(key.alias("k"), (start + off).alias("at"), (end - start).alias("size"), F.lit(bool(more or off)).alias("probe")))
    return F.array(*out)


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether the edit distance of two strings is at most tau: banded and bit-parallel.

    Bit d of level e stands for the diagonal d - tau: set if the prefix of b read so far turns into the prefix of a that
    ends on that diagonal with at most e edits. Reading one character of b moves all diagonals of a level at once.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1

    def at(x: Column, chars: Column, i: Column, d: int) -> Column:
        return F.when(F.get(chars, i + (d - tau)) == x, F.lit(1 << d)).otherwise(F.lit(0))

    def closed(levels: list[Column]) -> list[Column]:
        # a character of a left out: the next diagonal, one error more
        out = [levels[0]]
        for e in range(1, tau + 1):
            out.append(levels[e].bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(F.lit(full)))
        return out

    def step(chars: Column, acc: Column, c: Column) -> Column:
        match = F.lit(0)
        for d in range(width):
            match = match + at(c, chars, acc["i"], d)
        levels = [acc[f"r{e}"] for e in range(tau + 1)]
        moved = [levels[0].bitwiseAND(match)]
        for e in range(1, tau + 1):
            # substitution stays on the diagonal; a character of b left out moves one back
            moved.append(levels[e].bitwiseAND(match).bitwiseOR(levels[e - 1]).bitwiseOR(F.shiftright(levels[e - 1], 1)))
        return F.struct((acc["i"] + 1).alias("i"), *(x.alias(f"r{e}") for e, x in enumerate(closed(moved))))

    start = closed([F.lit(1 << tau)] + [F.lit(1 << tau)] * tau)
    begin = F.struct(F.lit(0).alias("i"), *(x.cast("int").alias(f"r{e}") for e, x in enumerate(start)))
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    run = F.get(
        F.transform(
            F.array(F.struct(F.when(F.length(a) > 0, chars_a).otherwise(F.array().cast("array<string>")).alias("a"), F.when(F.length(b) > 0, chars_b).otherwise(F.array().cast("array<string>")).alias("b"))),
            lambda p: F.aggregate(p["b"], begin, lambda acc, c: step(p["a"], acc, c), lambda acc: acc[f"r{tau}"]),
        ),
        F.lit(0),
    )
    # the end of a lies on the diagonal of the difference in length
    gap = F.length(a) - F.length(b)
    return (F.abs(gap) <= tau) & (F.call_function("shiftright", run, gap + tau).bitwiseAND(F.lit(1)) == 1)


def without_some(text: Column, tau: int) -> Column:
    """All strings that are left of a text without up to tau characters."""
    out = F.array(text)
    for _ in range(tau):
        out = F.array_distinct(F.flatten(F.transform(out, lambda t: F.transform(F.sequence(F.lit(0), F.length(t)), lambda p: F.concat(F.substring(t, F.lit(1), p), F.substring(t, p + 2, F.length(t)))))))
    return out


def linked(docs: DataFrame, tau: int = TAU, least: int = LEAST, bucket: int | None = None) -> DataFrame:
    """Links (a, b) between different lines of `least` characters or more within tau edits; a line is its MD5."""
    bucket = BUCKET if bucket is None else bucket
    line = F.col("line")
    rows = lines_of(docs).where(F.length(F.trim(line)) >= least)
    # which segments several lines share; equal lines are one here by their hash
    met = rows.select(F.xxhash64("line").alias("id"), F.explode(segments(line, tau)).alias("s")).select("id", "s.k", "s.probe")
    wanted = met.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("probe").alias("probed")).where("lo <> hi and not probed").select("k")
    wanted = cut(wanted)
    # the lines that have one, with their text
    found = rows.select(F.unhex(F.md5("line")).alias("h"), "line", F.explode(segments(line, tau)).alias("s")).select("h", "line", "s.*")
    found = cut(sieve(found, "k", wanted).distinct().join(wanted, "k"))
    sizes = found.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(sizes, "k")

    def met_by(rows: DataFrame, *keys: str) -> DataFrame:
        """Indexed lines beside all others of their key; of two lines of one length the lesser comes first."""
        one = rows.where("not probe").select(*keys, F.col("h").alias("a"), F.col("line").alias("la"))
        two = rows.select(*keys, F.col("h").alias("b"), F.col("line").alias("lb"), "probe")
        return one.join(two, [*keys]).where("a < b or probe and a <> b").select("a", "b", "la", "lb")

    cold = met_by(found.where(F.col("n") <= bucket), "k")
    rest = F.concat(F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("at") + F.col("size") + 1, F.length("line")))
    hot = found.where(F.col("n") > bucket).select("h", "line", "k", "probe", F.explode(F.transform(without_some(rest, tau), lambda t: F.xxhash64(t))).alias("v"))
    crowd = hot.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("probed")).where("n > 1 and not probed").select("k", "v")
    pairs = cold.union(met_by(hot.join(crowd, ["k", "v"]), "k", "v")).where(within(F.col("la"), F.col("lb"), tau))
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def judged(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(d, x, i, first, n_links, removed) of every line that isn't blank; first: the first place (d, i, x) of an equal line."""
    pairs = linked(docs, tau, least)
    rows = lines_of(docs).select("d", "x", "i", F.unhex(F.md5("line")).alias("h"))
    distinct = rows.groupBy("h").agg(F.min(F.struct("d", "i", "x")).alias("first"))
    both = pairs.union(pairs.select("b", "a")).toDF("h", "o")
    theirs = distinct.join(both.select(F.col("o").alias("h")).distinct(), "h", "left_semi").select(F.col("h").alias("o"), F.col("first").alias("theirs"))
    near = both.join(theirs, "o").groupBy("h").agg(F.count(F.lit(1)).alias("n_links"), F.min("theirs").alias("nearest"))
    verdict = distinct.join(near, "h", "left").select("h", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("nearest") < F.col("first")).alias("late"))
    place = F.struct("d", "i")
    return rows.join(verdict, "h").select("d", "x", "i", "first", "n_links", (F.coalesce("late", F.lit(False)) | (place > F.struct(F.col("first.d").alias("d"), F.col("first.i").alias("i")))).alias("removed"))


def line_verdicts(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no (from 0), class_doc_id and class_line_no (its first equal), n_links, removed."""
    return judged(docs, tau, least).select(id_back().alias("doc_id"), F.col("i").cast("long").alias("line_no"), id_back(F.col("first.d")).alias("class_doc_id"), F.col("first.i").cast("long").alias("class_line_no"), "n_links", "removed")


def without_repeats(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """docs with their later lines taken out of `text`; every row and every other column stays."""
    gone = judged(docs, tau, least).where("removed").groupBy("d", "x").agg(F.collect_set("i").alias("__gone"))
    names = docs.columns
    out = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__x": F.xxhash64(F.coalesce("text", F.lit("")))})
    gone = gone.toDF("__d", "__x", "__gone")
    kept = F.array_join(
        F.transform(
            F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda s: ~F.array_contains("__gone", s["i"])),
            lambda s: s["line"],
        ),
        "\n",
    )
    return out.join(gone, ["__d", "__x"], "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*names)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"))


def _candidates(tau: int) -> str:
    """SQL for the pairs of lines that share a segment at a place that the lengths allow."""
    out = []
    for more in range(tau + 1):
        for j in range(tau + 1):
            start, end = f"(a.n * {j} // {tau + 1})", f"(a.n * {j + 1} // {tau + 1})"
            for off in range(max(-j, more - (tau - j)), min(j, more + (tau - j)) + 1):
                apart = "a.line <> b.line" if more or off else "a.line < b.line"
                out.append(f"SELECT a.line AS a, b.line AS b FROM q a JOIN q b ON a.n = b.n - {more} AND substr(a.line, {start} + 1, {end} - {start}) = substr(b.line, {start} + {off} + 1, {end} - {start}) WHERE {apart}")
    return "\n  UNION ".join(out)


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
p AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
u AS (SELECT line, min({{'d': doc_id, 'i': i}}) AS f, length(line) AS n FROM p GROUP BY line),
q AS (SELECT line, n FROM u WHERE length(trim(line, ' ')) >= {LEAST}),
c AS ({_candidates(TAU)}),
k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM c WHERE levenshtein(a, b) <= {TAU}),
e AS (SELECT a AS line, b AS o FROM k UNION SELECT b, a FROM k),
v AS (
  SELECT u.line, any_value(u.f) AS f, count(o.line) AS n_links, coalesce(min(o.f) < any_value(u.f), false) AS late
  FROM u LEFT JOIN e ON e.line = u.line LEFT JOIN u o ON o.line = e.o GROUP BY u.line)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, f.d AS class_doc_id, CAST(f.i AS BIGINT) AS class_line_no, n_links,
  late OR doc_id > f.d OR (doc_id = f.d AND i > f.i) AS removed
FROM p JOIN v USING (line)
"""
