"""Lookups of known-exploited and exploit-probability feeds by the aliases of a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a feed is broadcast; beyond that Spark chooses.
SMALL = 500_000


def _small(feed: DataFrame) -> DataFrame:
    return F.broadcast(feed) if feed.limit(SMALL + 1).count() <= SMALL else feed


def exploit(findings: DataFrame, key: str, aliases: Column, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """(key, in_kev, epss, canonical) of each row: any alias in the KEV feed (cve), the greatest EPSS of its aliases
    (cve, epss), the smallest CVE among them.

    Of an EPSS feed's rows of one CVE the last holds, by `ordinal` if it has one, else the greatest. Rows of one key
    share their lookups; an alias that comes twice changes nothing in them, so none is sought out. Both feeds are one
    table to look up in.
    """
    each = findings.select(key, F.explode_outer(aliases).alias("cve"))
    ordered = "ordinal" in epss.columns
    own = [F.lit(None).cast(epss.schema[c].dataType).alias(c) for c in ("epss", *(["ordinal"] if ordered else []))]
    feeds = kev.select("cve", F.lit(True).alias("listed"), *own).unionByName(epss.select("cve", F.lit(None).cast("boolean").alias("listed"), "epss", *(["ordinal"] if ordered else [])))
    last = F.max_by("epss", "ordinal") if ordered else F.max("epss")
    known = _small(feeds.groupBy("cve").agg(F.bool_or("listed").alias("listed"), last.alias("epss")))
    named = F.min(F.when(F.col("cve").startswith("CVE-"), F.col("cve")))
    # the smallest of texts is found by sorting: over the rows of a shuffle's partition, which are fewer than a file's part
    return each.join(known, "cve", "left").repartition(key).groupBy(key).agg(F.coalesce(F.bool_or("listed"), F.lit(False)).alias("in_kev"), F.max("epss").alias("epss"), named.alias("canonical"))


def cve_aliases(evidence: Column) -> Column:
    """All CVEs that a merged finding's evidence names in its details."""
    found = F.transform(evidence, lambda e: F.coalesce(F.from_json(e["detail"], "cve_aliases array<string>")["cve_aliases"], F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def canonical_id(aliases: Column, own: Column) -> Column:
    """The smallest CVE among an advisory's names, else its own id."""
    return F.coalesce(F.array_min(F.filter(aliases, lambda a: a.startswith("CVE-"))), own)
