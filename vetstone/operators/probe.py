"""Web exposures over a table of captured responses, the scope that allows a probe, and its rate limits. No traffic."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetstone.functions import text as T


def matcher(m: dict) -> Column:
    """Whether a response (status, headers, body) meets a matcher."""
    kind = m["type"]
    if kind == "status":
        return F.coalesce(F.col("status").isin(*m["values"]), F.lit(False))
    part = F.coalesce(F.col("headers" if m.get("part") == "header" else "body"), F.lit(""))
    if kind == "regex":
        return reduce(lambda a, p: a | part.rlike(p), m["patterns"], F.lit(False))
    if kind == "word":
        return reduce(lambda a, w: a | part.contains(w), m["words"], F.lit(False))
    raise ValueError(f"no such matcher: {kind}")


def condition(request: dict) -> Column:
    """All matchers, or any; all of none hold, any of none doesn't."""
    every = request.get("condition", "and") == "and"
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), map(matcher, request["matchers"]), F.lit(every))


def evaluate(responses: DataFrame, templates: list[dict]) -> DataFrame:
    """(template_id, severity, origin, path, evidence): templates are few and fixed, so they are expressions on a row."""
    hits = []
    for t in templates:
        for r in t["requests"]:
            here = F.col("path").isin(*r["path"]) if r.get("path") else F.lit(True)
            here &= F.col("method") == r.get("method", "GET")
            hits.append(F.when(here & condition(r), F.struct(F.lit(t["id"]).alias("template_id"), F.lit(t["severity"]).alias("severity"))))
    rows = responses.withColumn("t", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))))
    evidence = F.concat(T.capped(T.redacted(F.coalesce("headers", F.lit(""))), 512), F.lit("\n\n"), T.capped(T.redacted(F.coalesce("body", F.lit(""))), 4096))
    return rows.select("t.template_id", "t.severity", "origin", "path", F.lit("proven").alias("confidence"), evidence.alias("evidence"))


def in_scope(host: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes beat includes; `*.x` needs a label before x; what isn't included is denied."""

    def one(pattern: str) -> Column:
        pattern = pattern.lower()
        return host.endswith(pattern[1:]) & (F.length(host) > len(pattern) - 1) if pattern.startswith("*.") else host == pattern

    def some(patterns: list[str]) -> Column:
        return reduce(lambda a, p: a | one(p), patterns, F.lit(False))

    return some(include) & ~some(exclude)


SUFFIXES = frozenset("com org net edu gov mil int io dev app info biz co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp co.nz com.br co.in co.za de fr es it nl eu uk us jp cn in br au ca ch".split())


def check_scope(patterns: list[str]) -> None:
    """Refuses wildcards over a whole public suffix."""
    for p in patterns:
        if p.startswith("*.") and p[2:].lower() in SUFFIXES:
            raise ValueError(f"{p} covers a public suffix")


def method_allowed(method: Column, profile: str, permitted: list[str]) -> Column:
    ok = F.upper(method).isin(*(p.upper() for p in permitted))
    return ok & F.upper(method).isin("GET", "HEAD", "OPTIONS") if profile in ("quick", "standard") else ok


def breaker(requests: DataFrame, window_ms: int = 60_000, least: int = 5, most: float = 0.2) -> DataFrame:
    """Adds samples, failures and abort: the trailing window before each request of a host. requests: host, ts_ms, status."""
    w = Window.partitionBy("host").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    bad = (F.col("status") >= 500).cast("long")
    # the request itself isn't known yet when the breaker is asked; ties in time are
    out = requests.withColumn("samples", F.count(F.lit(1)).over(w) - 1).withColumn("failures", F.sum(bad).over(w) - bad)
    return out.withColumn("abort", (F.col("samples") >= least) & (F.col("failures") >= most * F.col("samples")))


def token_bucket(requests: DataFrame, rps: float) -> DataFrame:
    """(host, ts_ms, wait_ms) of requests (host, ts_ms): 0 if a token was there, else the time until there is one. After a
    wait the request goes without a token. Hosts are independent; each one's requests are read in order of time, with the
    bucket's state alone kept between them, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, at, tokens = None, 0, float(rps)
        for b in batches:
            waits = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != host:
                    host, at, tokens = h, t, float(rps)
                tokens = min(float(rps), tokens + (t - at) / 1000.0 * rps)
                at = t
                waits.append(0 if tokens >= 1 else math.ceil((1 - tokens) / rps * 1000))
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(waits, pa.int64())], ["host", "ts_ms", "wait_ms"])

    rows = requests.where(F.col("ts_ms").isNotNull()).select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), F.col("ts_ms").cast("long").alias("ts_ms"))
    return rows.repartition("host").sortWithinPartitions("host", "ts_ms").mapInArrow(run, "host string, ts_ms long, wait_ms long")
