"""Who may probe what, and a record of each decision. All of it is decided before any traffic."""

from __future__ import annotations

import struct
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetstone.functions import ed25519
from vetstone.operators.probe import check_scope, in_scope

DOMAIN = b"vetstone:authorization:v1"


def _field(value: str) -> bytes:
    data = value.encode()
    return struct.pack("<Q", len(data)) + data


def signed_bytes(a: dict, domain: bytes = DOMAIN) -> bytes:
    """What is signed: the domain, then each field, counted and with its length, whatever order a file has them in."""
    out = domain + b"".join(_field(str(a[k])) for k in ("id", "attestation", "valid_from", "valid_until", "profile"))
    for k in ("include", "exclude"):
        out += struct.pack("<Q", len(a.get(k, []))) + b"".join(_field(x) for x in a.get(k, []))
    return out


def verified(a: dict, signature: bytes, trusted: bytes | None, now: str) -> dict:
    """The authorization, or PermissionError with the first reason against it: no attestation, a signature that isn't the
    trusted key's, a moment outside its window (both ends belong to it), a scope that is too wide."""
    if not str(a.get("attestation", "")).strip():
        raise PermissionError("no attestation")
    if trusted is None or not ed25519.verify(trusted, signed_bytes(a), signature):
        raise PermissionError("the signature isn't the trusted key's")
    at = datetime.fromisoformat(now)
    if not datetime.fromisoformat(a["valid_from"]) <= at <= datetime.fromisoformat(a["valid_until"]):
        raise PermissionError("not valid now")
    try:
        check_scope(a["include"])
    except ValueError as e:
        raise PermissionError(str(e)) from e
    return a


def decided(requests: DataFrame, a: dict, now: Column) -> DataFrame:
    """Adds at, auth, rule and allowed to requests (method, target, host): each is in scope or denied."""
    out = F.lower(F.col("host"))
    excluded = in_scope(out, a.get("exclude", []), []) if a.get("exclude") else F.lit(False)
    rule = F.when(excluded, "deny:excluded").when(in_scope(out, a["include"], []), "allow:included").otherwise("deny:not-included")
    return requests.select("*", now.alias("at"), F.lit(a["id"]).alias("auth"), rule.alias("rule"), rule.startswith("allow").alias("allowed"))


def audit(decisions: DataFrame, path: str) -> None:
    """Appends a line for each decision: moment, authorization, method, target, rule. An error ends the scan: nothing is
    probed that wasn't recorded."""
    line = F.concat_ws("\t", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "auth", "method", F.regexp_replace("target", "[\t\r\n]", " "), "rule")
    decisions.select(line.alias("value")).write.mode("append").text(path)
