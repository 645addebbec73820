"""Packs of rules as data: secrets (JSON), policies (JSON), probe templates (YAML). A pack is small and read by the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from vetstone import packs
from vetstone import schema as S

MOST_RULES, LONGEST_PATTERN = 10_000, 4_096
METHODS = ("GET", "HEAD", "OPTIONS")


def read(spark: SparkSession, path: str) -> str:
    """A pack's text, from whatever store Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file


def compiles(pattern: str) -> bool:
    """Whether a pattern can be used; inline flags and classes that only other engines know count as unusable."""
    try:
        re.compile(pattern)
    except (re.error, OverflowError):
        return False
    return True


def secret_rules(text: str) -> list[dict]:
    """A pack's rules; too many of them are an error, a rule that is too long or doesn't compile is left out."""
    rules = json.loads(text)["rules"]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} are the most")
    return [r for r in rules if len(r["pattern"].encode()) <= LONGEST_PATTERN and compiles(r["pattern"]) and r["severity"] in S.SEVERITY and r["confidence"] in S.CONFIDENCE]


def policies(text: str) -> list[dict]:
    from vetstone.operators.policy import checked

    return [checked(p) for p in json.loads(text)["policies"]]


def templates(text: str) -> list[dict]:
    """Probe templates; one that asks for a method that changes things is an error."""
    import yaml

    out = yaml.safe_load(text) or []
    for t in out:
        for r in t.get("requests", []):
            if str(r.get("method", "GET")).upper() not in METHODS:
                raise ValueError(f"{t.get('id')}: {r['method']} isn't one of {', '.join(METHODS)}")
    return out


def severities(pack: list[dict]) -> dict[str, str]:
    """Severity by rule id."""
    return {r["id"]: r["severity"] for r in pack}


def resolved(kind: str, snapshot: str | None = None, pin: str | None = None) -> tuple[list[dict], str | None]:
    """(the pack to use, a warning): a snapshot's pack if it parses and is the pinned `id@version`, else the shipped one."""
    load, shipped = {"secrets": (secret_rules, packs.SECRET_RULES), "policies": (policies, packs.POLICIES)}[kind]
    if snapshot is None:
        return shipped, f"{kind}: no pack for {pin}; the shipped one is used" if pin else None
    try:
        rules, head = load(snapshot), json.loads(snapshot)
    except (ValueError, KeyError, TypeError) as e:
        return shipped, f"{kind}: the snapshot's pack can't be read ({e}); the shipped one is used"
    name = f"{head.get('pack_id')}@{head.get('version')}"
    if pin and name != pin:
        return shipped, f"{kind}: the snapshot has {name}, not {pin}; the shipped one is used"
    return rules, None
