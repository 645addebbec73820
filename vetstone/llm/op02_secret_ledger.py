"""Secret scans with an incremental blob ledger.

Every text is a blob named by its SHA-256; a blob is scanned once per rule version however many paths (documents) hold
it, and never again once the ledger has the pair. Findings join back to all paths. DataFrame functions only.

Spans are in code points, end exclusive, leftmost and non-overlapping per rule: matches of the rule's expression, of
which those whose group is too short are dropped after matching. Starts come from the pieces between matches, which
`split` gives, so that no engine but Spark's own regular expressions is needed.

Null text is empty (no findings); repeated rows and null ids are paths of their own and kept as they come; very long
texts are one blob each, scanned whole; extra columns are ignored, clashing names too. Of equal spans (ties) of one rule
there is one; spans of different rules at one place stand in the rules' order. Empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import table


#: Spans that are put together before they join those found so far: a fold copies what it has at each step.
BLOCK = 256


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    # shorter runs than 24 fail anyway, and runs are maximal: the bound in the expression changes no match
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text."""
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast(SPAN)

    def step(parts: Column, acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(parts["between"], i))
        end = start + F.length(F.get(parts["match"], i))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        long_enough = F.length(F.get(parts["value"], i)) >= rule.least
        some = F.when(long_enough, F.concat(acc["some"], F.array(span))).otherwise(acc["some"])
        full = F.size(acc["some"]) >= BLOCK - 1
        return F.struct(end.alias("at"), F.when(full, none).otherwise(some).alias("some"), F.when(full, F.concat(acc["out"], F.array(some))).otherwise(acc["out"]).alias("out"))

    one = F.transform(
        F.array(parts),  # evaluated once, then bound
        lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p["match"]) - 1),
            F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("some"), F.array().cast(f"array<{SPAN}>").alias("out")),
            lambda acc, i: step(p, acc, i),
            lambda acc: F.concat(F.flatten(acc["out"]), acc["some"]),
        ),
    )
    return F.when(text.rlike(rule.pattern), F.get(one, F.lit(0))).otherwise(none)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings by path, (doc_id, spans), and the ledger's new rows, (blob, kind, version, spans).

    ledger: rows of earlier scans; pairs it has are not scanned again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    no_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    paths = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), no_id.alias("d"), F.xxhash64("text").alias("x"))
    holders = paths.groupBy("blob").agg(F.min(F.struct("d", "x")).alias("at"))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        holders = holders.join(known, "blob", "left").withColumn("todo", F.transform(F.array_except(pairs, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))), lambda p: p["kind"])).where(F.size("todo") > 0)
    else:
        holders = holders.withColumn("todo", F.array(*(F.lit(r.kind) for r in rules)))
    unseen = holders.select("blob", "todo", F.col("at.d").alias("d"), F.col("at.x").alias("x"))
    texts = rows.select(no_id.alias("d"), F.xxhash64("text").alias("x"), "text")
    got = texts.join(unseen, ["d", "x"]).select(
        "blob",
        *(F.when(F.array_contains("todo", r.kind), spans(F.col("text"), r, i)).alias(r.kind) for i, r in enumerate(rules)),
    )
    new = (
        got.select("blob", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules))).alias("e"))
        .select("blob", "e.*")
        .where(F.col("spans").isNotNull())
    )
    hits = new.where(F.size("spans") > 0)
    if ledger is not None:
        current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        hits = hits.unionByName(ledger.select("blob", "kind", "version", "spans").where((F.size("spans") > 0) & F.array_contains(current, F.struct("kind", "version"))))
    # repeated rows give equal spans: distinct, then in order
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = paths.select("doc_id", "blob").join(by_blob, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return found, new.dropDuplicates(["blob", "kind", "version"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kinds):
    return lambda s: s["kind"].isin(*kinds)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and the spans in writing."""
    base = [r.kind for r in rules if r.base]
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _of((k,)))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_written(F.filter("spans", _of(base))), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"))[0])


def _sql() -> str:
    def one(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m,
  regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}')"""

    union = "\nUNION ALL ".join(one(i, r) for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({union}),
y AS (SELECT doc_id, rank, kind, least, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (
  SELECT doc_id, rank, kind,
    list_sum(list_transform(b[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0) AS s, length(m[i]) AS n
  FROM y WHERE length(v[i]) >= least),
w AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS e FROM z),
g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
    string_agg(e, ',' ORDER BY s, rank) FILTER (rank <= 2) AS base, string_agg(e, ',' ORDER BY s, rank) AS spans
  FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
