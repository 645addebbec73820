"""Vulnerability feeds from a snapshot directory whose manifest names the digest of every file."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OSV = (
    "id string, summary string, aliases array<string>, database_specific struct<severity:string,cwe_ids:array<string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)


def kev(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vulnerabilities array<struct<cveID:string>>").json(path, multiLine=True).select(F.explode("vulnerabilities.cveID").alias("cve")).distinct()


def epss(spark: SparkSession, path: str) -> DataFrame:
    """A malformed row is an error, not a gap."""
    return spark.read.csv(path, schema="cve string, epss double, percentile double", header=True, comment="#", mode="FAILFAST", enforceSchema=True)


def osv(spark: SparkSession, path: str) -> DataFrame:
    """Advisories of one or more JSON-lines files; lines that can't be read are left out."""
    return spark.read.schema(OSV).json(path, mode="DROPMALFORMED").where("id is not null")


def open_snapshot(root: str) -> dict:
    """The current snapshot's manifest, after every file's digest has been compared."""
    name = (Path(root) / "CURRENT").read_text().strip()
    if not re.fullmatch(r"[0-9]{8}-[0-9a-f]{12}", name):
        raise ValueError(f"no snapshot id: {name!r}")
    at = Path(root) / name
    manifest = json.loads((at / "manifest.json").read_text())
    if manifest["snapshot_id"] != name:
        raise ValueError("the manifest is of another snapshot")
    for f, x in manifest["files"].items():
        if "sha256:" + hashlib.sha256((at / f).read_bytes()).hexdigest() != x["digest"]:
            raise ValueError(f"{f} differs from its digest")
    return manifest | {"path": str(at)}


def write_snapshot(root: str, as_of: str, files: dict[str, bytes]) -> str:
    """Stages the files, renames them into place and points CURRENT at them; gives the id."""
    digests = {k: "sha256:" + hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}
    name = f"{as_of[:10].replace('-', '')}-{hashlib.sha256(json.dumps(digests).encode()).hexdigest()[:12]}"
    base = Path(root)
    stage = base / f".{name}.tmp"
    for k, v in files.items():
        p = stage / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(v)
    manifest = {"snapshot_id": name, "as_of": as_of, "files": {k: {"digest": d, "bytes": len(files[k])} for k, d in digests.items()}}
    (stage / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
    if not (base / name).exists():
        stage.rename(base / name)
    pointer = base / ".CURRENT.tmp"
    pointer.write_text(name)
    pointer.rename(base / "CURRENT")
    return name


def age(spec: str) -> int:
    """Seconds of 7d, 12h, 30m or 45s."""
    if not (m := re.fullmatch(r"(\d+)([dhms])", spec)):
        raise ValueError(f"no duration: {spec!r}")
    return int(m[1]) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[m[2]]


def staleness(as_of: str, now: str, most: str) -> int | None:
    """Hours that a snapshot is old if that is more than `most` (7d, 12h), else None. Moments are RFC 3339."""
    seconds = (datetime.fromisoformat(now) - datetime.fromisoformat(as_of)).total_seconds()
    return int(seconds // 3600) if seconds > age(most) else None
