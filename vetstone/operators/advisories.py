"""Vulnerable packages: an equi join on (ecosystem, name) with a version-range condition on what meets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetstone.functions import versions as V
from vetstone.operators.enrich import canonical_id

RANGES = "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"


def package_name(ecosystem: Column, name: Column) -> Column:
    """A name as its ecosystem compares names."""
    base = F.split_part(ecosystem, F.lit(":"), F.lit(1))
    return F.when(base == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(base == "npm", F.lower(name)).otherwise(name)


def unbounded(ranges: Column) -> Column:
    """Ranges none of whose events ends them."""
    return F.filter(ranges, lambda r: F.forall(r["events"], lambda e: e["fixed"].isNull() & e["last_affected"].isNull()))


def _ranges(listed: list, ranges: list[dict]) -> list[list[dict]]:
    """The events of the ranges that count: git ranges don't, nor, beside a list, ranges without an end."""
    return [r["events"] for r in ranges if r["type"] != "GIT" and not (listed and not any(e.get("fixed") or e.get("last_affected") for e in r["events"]))]


def _plain(ranges) -> list[dict]:
    return [{"type": r["type"], "events": list(r["events"]) if r["events"] is not None else []} for r in (ranges if ranges is not None else [])]


@F.pandas_udf(T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("fix", T.StringType())]))
def judged(scheme: pd.Series, version: pd.Series, listed: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """Whether a version is affected, and the least version that fixes it. A listed version is affected at once."""
    hits, fixes = [], []
    for s, v, names, rs in zip(scheme, version, listed, ranges, strict=True):
        names = list(names) if names is not None else []
        rs = _plain(rs)
        hit = v in names or any(V.in_range(s, v, events) for events in _ranges(names, rs))
        hits.append(hit)
        fixes.append(V.lowest_fix(s, v, rs) if hit else None)
    return pd.DataFrame({"hit": hits, "fix": fixes})


#: Opaque to the optimizer, which would otherwise run it in the filter and again in the projection.
judged = judged.asNondeterministic()



def _texts(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


def _keyed(listed, ranges) -> dict:
    """An entry's ranges with sort keys (V.semver_text): bounds and fixes in order."""
    names, rs = list(listed) if listed is not None else [], _plain(ranges)
    spans = [
        sorted(({"kind": k, "key": "" if e[k] == "0" else V.semver_text(e[k])} for e in events for k in V.BOUNDS if e.get(k)), key=lambda b: b["key"])
        for events in _ranges(names, rs)
    ]
    fixes = [{"key": V.semver_text(e["fixed"]), "fixed": e["fixed"]} for r in rs for e in r["events"] if e.get("fixed")]
    return {"spans": spans, "fixes": sorted(fixes, key=lambda f: f["key"])}


@F.pandas_udf(T.StructType([T.StructField("spans", T.ArrayType(_texts("kind", "key"))), T.StructField("fixes", _texts("key", "fixed"))]))
def keyed(listed: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_keyed(*x) for x in zip(listed, ranges, strict=True)], columns=["spans", "fixes"])


def _inside(span: Column, key: Column) -> Column:
    """V.in_range() over bounds in order."""

    def turn(inside: Column, b: Column) -> Column:
        opens, ends = b["kind"] == "introduced", F.when(b["kind"] == "fixed", key >= b["key"]).otherwise(key > b["key"])
        return F.when(opens, inside | (key >= b["key"])).otherwise(inside & ~ends)

    return F.aggregate(span, F.lit(False), turn)


def _native(version: Column, listed: Column, entry: Column) -> Column:
    """judged() for semantic versions, as an array that is empty where nothing holds: an explode then is the filter, and
    nothing is evaluated twice."""

    def verdict(key: Column) -> Column:
        hit = F.coalesce(F.array_contains(listed, version), F.lit(False)) | F.exists(entry["spans"], lambda s: _inside(s, key))
        return F.when(hit, F.struct(F.get(F.filter(entry["fixes"], lambda f: f["key"] > key), F.lit(0))["fixed"].alias("fix")))

    return F.array_compact(F.transform(F.array(V.semver_text_of(version)), verdict))


def affected(osv: DataFrame) -> DataFrame:
    """One row for each affected entry of each advisory: the build side of the join."""
    rows = osv.select("id", "summary", "aliases", F.col("database_specific.severity").alias("label"), F.col("database_specific.cwe_ids").alias("cwe"), F.explode("affected").alias("a"))
    name = package_name(F.col("a.package.ecosystem"), F.col("a.package.name"))
    return rows.select("id", "summary", canonical_id(F.coalesce("aliases", F.array().cast("array<string>")), F.col("id")).alias("advisory"), "aliases", "label", "cwe", F.col("a.package.ecosystem").alias("ecosystem"), name.alias("key"), "a.versions", "a.ranges")


def severity(label: Column) -> Column:
    up = F.upper(label)
    return F.when(up == "CRITICAL", "critical").when(up == "HIGH", "high").when(up == "LOW", "low").otherwise("medium")


def match(packages: DataFrame, osv: DataFrame) -> DataFrame:
    """packages (any columns with ecosystem, name, version) x the advisories that hold for them.

    Semantic versions are compared natively with keys that each entry gets once; other schemes are judged pair by pair.
    """
    left, entries = packages.where(F.col("version").isNotNull()).withColumn("key", package_name(F.col("ecosystem"), F.col("name"))), affected(osv)
    semver = V.scheme(F.col("ecosystem")) == "semver"

    def out(met: DataFrame) -> DataFrame:
        return met.select(*packages.columns, "id", "advisory", "summary", severity(F.col("label")).alias("severity"), "cwe", "aliases", F.col("j.fix").alias("fixed_version"))

    # a small file of advisories is one task's: spread, as the join wants it
    bounds = entries.where(semver).repartition("ecosystem", "key").withColumn("e", keyed("versions", "ranges")).drop("ranges")
    native = left.where(semver).join(bounds, ["ecosystem", "key"])
    native = native.withColumn("j", F.explode(_native(F.col("version"), F.col("versions"), F.col("e"))))
    pairs = left.where(~semver).join(entries.where(~semver), ["ecosystem", "key"])
    pairs = pairs.withColumn("j", judged(V.scheme(F.col("ecosystem")), F.col("version"), F.col("versions"), F.col("ranges"))).where("j.hit")
    return out(native).unionByName(out(pairs))


def unpinned(packages: DataFrame) -> DataFrame:
    """Dependencies without a version: reported even without any feed."""
    return packages.where(F.col("version").isNull()).select("*", F.lit("native:sca:unpinned").alias("advisory"), F.lit("informational").alias("severity"), F.lit("unconfirmed").alias("confidence"))


def distro_ecosystem(distro: Column, version_id: Column) -> Column:
    major = F.split_part(version_id, F.lit("."), F.lit(1))
    return (
        F.when(distro == "debian", F.concat(F.lit("Debian:"), major))
        .when(distro == "ubuntu", F.concat(F.lit("Ubuntu:"), version_id))
        .when(distro == "alpine", F.concat(F.lit("Alpine:v"), F.regexp_extract(version_id, "^([0-9]+\\.[0-9]+)", 1)))
        .when(distro.isin("rhel", "centos"), F.lit("Red Hat"))
        .when(distro == "rocky", F.concat(F.lit("Rocky Linux:"), major))
        .when(distro == "almalinux", F.concat(F.lit("AlmaLinux:"), major))
        .when(distro == "fedora", F.concat(F.lit("Fedora:"), version_id))
    )


def purl(purl_type: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), purl_type, F.lit("/"), name, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def inventory(packages: DataFrame) -> DataFrame:
    """Packages by purl; of several the one from the last path, and the last in it, stays. packages: with path, ordinal."""
    p = purl(F.col("purl_type"), F.col("name"), F.col("version"))
    row = F.struct(*packages.columns)
    return packages.withColumn("purl", p).groupBy("purl").agg(F.max_by(row, F.struct("path", "ordinal")).alias("r")).select("purl", "r.*").orderBy("purl")


def raw(matches: DataFrame, engine: str = "sca") -> DataFrame:
    """match()'s rows (with purl_type and path) in the common shape of observations."""
    p = purl(F.col("purl_type"), F.col("name"), F.col("version"))
    names = F.to_json(F.struct(F.filter(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("id")), lambda a: a.startswith("CVE-")).alias("cve_aliases")))
    fix = F.struct(F.col("fixed_version").isNotNull().alias("fix_available"), F.col("fixed_version").alias("fixed_version"), F.when(F.col("fixed_version").isNotNull(), F.concat(F.lit("Upgrade to "), "fixed_version", F.lit(" or later"))).alias("summary"))
    return matches.select(
        F.lit(engine).alias("engine_id"), F.col("advisory").alias("rule_id"),
        F.struct(F.lit("vulnerable_dependency").alias("finding_class"), p.alias("f1"), F.col("advisory").alias("f2"), F.col("path").alias("f3")).alias("identity"),
        F.concat_ws(" ", "name", "version", F.lit("is affected by"), "advisory").alias("title"), F.col("summary").alias("description"), "severity", F.lit("corroborated").alias("confidence"),
        F.struct(F.lit("repository").alias("kind"), F.col("path").alias("identifier")).alias("asset"), F.struct(F.col("path").alias("path"), F.lit(None).cast("long").alias("line")).alias("location"),
        F.array(F.struct(F.lit("advisory_match").alias("kind"), F.concat_ws(" ", p, "id").alias("summary"), names.alias("detail"), F.array().cast("array<string>").alias("dependency_path"))).alias("evidence"),
        fix.alias("remediation"), F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"),
    )


def os_packages(packages: DataFrame, distro: Column, version_id: Column) -> DataFrame:
    """Packages of an image (name, version) as match() takes them: their ecosystem, and the type that their purl begins with."""
    kind = F.when(distro.isin("debian", "ubuntu"), "deb").when(distro == "alpine", "apk").otherwise("rpm")
    return packages.select("*", distro_ecosystem(distro, version_id).alias("ecosystem"), F.concat(kind, F.lit("/"), distro).alias("purl_type"))
