"""Suppressions, baselines, gates, floods, and the findings' history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetstone import schema as S
from vetstone.functions.paths import glob_regex

FLOOD, SAMPLES = 10, 3
EPSILON = 0.001


def until(expires: Column) -> Column:
    """A moment, or the last second of a bare date."""
    return F.when(expires.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.to_timestamp(F.concat(expires, F.lit("T23:59:59Z")))).otherwise(F.to_timestamp(expires))


def suppressed_by_config(findings: DataFrame, rules: list[dict], now: Column) -> Column:
    """Whether an unexpired rule of the configuration covers a finding. A rule's selectors must all hold; one is needed."""
    out = F.lit(False)
    for r in rules:
        parts = []
        if r.get("finding_id"):
            parts.append(F.col("finding_id") == r["finding_id"])
        if r.get("rule_id"):
            parts.append(_has_rule(r["rule_id"]))
        if r.get("path"):
            parts.append(F.coalesce(F.col("location.path").rlike(glob_regex(r["path"])), F.lit(False)))
        if not parts:
            continue
        hit = until(F.lit(r["expires"])) > now
        for p in parts:
            hit &= p
        out |= hit
    return out


def _has_rule(rule_id: str) -> Column:
    return F.exists("sources", lambda s: s["rule_id"] == rule_id)


def suppressed_by_store(findings: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """The findings that an unexpired stored suppression names."""
    return findings.join(suppressions.where(until(F.col("expires")) > now).select("finding_id"), "finding_id", "left_semi")


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("finding_id").distinct(), "finding_id", "left_anti")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(finding_id, change): added, removed or kept, both sides in one join."""
    a = before.select("finding_id").distinct().withColumn("a", F.lit(True))
    b = after.select("finding_id").distinct().withColumn("b", F.lit(True))
    both = a.join(b, "finding_id", "full_outer")
    return both.select("finding_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change"))


def gate(findings: DataFrame, min_score: float | None = None, min_severity: str | None = None) -> DataFrame:
    """The findings that fail a build: at least this score, or at least this severity."""
    hit = F.lit(False)
    if min_score is not None:
        hit |= F.col("risk_score") >= min_score
    if min_severity is not None:
        hit |= S.rank(F.col("severity"), S.SEVERITY) >= S.SEVERITY.index(min_severity)
    return findings.where(hit)


def collapse(findings: DataFrame, keys: list[str], order: list[Column], line: str = "line", most: int = FLOOD) -> DataFrame:
    """One row for each flood (over `most` rows of equal keys), at its first row's place, with its size and lowest lines.

    Sizes and lines come from a group-by with bounded state, not from a window over a hot group's rows.
    """
    flood = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("flood_size"), F.min(F.struct(*order)).alias("__head"))
    floods = flood.where(F.col("flood_size") > most)
    lines = findings.join(floods.select(*keys), keys, "left_semi").groupBy(*keys, line).count()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    top = lines.withColumn("r", rank).where(F.col("r") <= SAMPLES).groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("sample_lines"))
    out = findings.join(flood, keys).where((F.col("flood_size") <= most) | (F.struct(*order) == F.col("__head"))).drop("__head")
    return out.join(top, keys, "left")


def upsert(current: DataFrame, incoming: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the new state, the events): rows are (finding_id, status, risk_score, finding_json, first_seen, last_seen)."""
    new = incoming.select("finding_id", F.col("status").alias("n_status"), F.col("risk_score").alias("n_score"), F.col("finding_json").alias("n_json"))
    both = current.join(new, "finding_id", "full_outer")
    here = F.col("n_status").isNotNull()
    state = both.select(
        "finding_id",
        F.coalesce("n_status", "status").alias("status"),
        F.coalesce("n_score", "risk_score").alias("risk_score"),
        F.coalesce("n_json", "finding_json").alias("finding_json"),
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(here, at).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    old = F.col("status").isNotNull()

    def event(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("from_val"), b.cast("string").alias("to_val"))

    none = F.lit(None)
    events = F.array_compact(
        F.array(
            F.when(here & ~old, event("first_seen", none, F.col("n_status"))),
            F.when(here & old & (F.col("status") != F.col("n_status")), event("status_changed", F.col("status"), F.col("n_status"))),
            F.when(here & old & (F.abs(F.col("risk_score") - F.col("n_score")) > EPSILON), event("score_changed", F.col("risk_score"), F.col("n_score"))),
        )
    )
    return state, both.select("finding_id", at.alias("at"), F.explode(events).alias("e")).select("finding_id", "at", "e.*")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """What is shown to people: findings of a severity or worse. Machine formats aren't filtered."""
    return findings.where(S.rank(F.col("severity"), S.SEVERITY) >= S.SEVERITY.index(severity))


def by_prefix(findings: DataFrame, prefix: str) -> DataFrame:
    """The finding whose id begins so; none or several are an error."""
    found = findings.where(F.col("finding_id").startswith(prefix))
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"no finding begins with {prefix!r}" if not n else f"{prefix!r} is ambiguous ({found.count()} findings); use more digits")
    return found


def put_suppressions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored suppressions (finding_id, reason, expires) with new ones in the place of old ones of the same id."""
    return current.join(incoming, "finding_id", "left_anti").unionByName(incoming)


#: Which engines look at which layer.
LAYERS = {"code": ("sast", "secrets"), "dependencies": ("sca",), "infrastructure": ("iac",), "image": ("sca",), "web": ("probe",)}


def engines(layers: list[str], applicable: dict[str, bool]) -> list[str]:
    """The engines that a scan of some layers runs: those that have one of them and something to look at."""
    return [e for e in dict.fromkeys(x for names in LAYERS.values() for x in names) if applicable.get(e, False) and any(e in LAYERS[layer] for layer in layers)]
