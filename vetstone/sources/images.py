"""Container images: layers in memory, operating-system releases and package databases."""

from __future__ import annotations

import gzip
import io
import posixpath
import sqlite3
import struct
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_BYTES, MOST_ENTRY = 2_000_000, 10 * 2**30, 4 * 2**30
OPAQUE, GONE = ".wh..wh..opq", ".wh."


def entries(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(path, kind, content) of a layer: file, gone (a path deleted) or opaque (a directory emptied). Names and links that
    would leave the root are refused."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    total = 0
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for k, m in enumerate(tar):
            if k >= MOST_ENTRIES or total > MOST_BYTES:
                raise ValueError("layer too large")
            path = posixpath.normpath(m.name)
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), m.linkname)) if m.issym() else posixpath.normpath(m.linkname) if m.islnk() else ""
            if m.name.startswith("/") or path.startswith("..") or target.startswith(("..", "/")) and m.islnk():
                raise ValueError(f"unsafe entry {m.name}")
            folder, name = posixpath.split(path)
            if name == OPAQUE:
                yield folder, "opaque", b""
            elif name.startswith(GONE):
                yield posixpath.join(folder, name[len(GONE) :]), "gone", b""
            elif m.isfile() and m.size <= MOST_ENTRY:
                total += m.size
                yield path, "file", tar.extractfile(m).read()


def extracted(layers: DataFrame) -> DataFrame:
    """(path, content) of an image's files. layers: layer_no, content. The last layer that has a path wins; a deletion
    hides the path and what is below it in earlier layers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no, data in zip(pdf.layer_no, pdf.content, strict=True):
                rows = [(no, *x) for x in entries(bytes(data))]
                yield pd.DataFrame(rows, columns=["layer_no", "path", "kind", "content"])

    rows = layers.select(F.col("layer_no").cast("int").alias("layer_no"), "content").mapInPandas(run, "layer_no int, path string, kind string, content binary")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("layer_no")))
    files = rows.where("kind = 'file'").withColumn("r", last).where("r = 1").drop("r", "kind")
    from vetstone.functions.paths import ancestors

    gone = rows.where("kind <> 'file'").groupBy(F.col("path").alias("up"), "kind").agg(F.max("layer_no").alias("no"))
    up = files.select("path", "layer_no", F.explode(ancestors(F.col("path"))).alias("up"))
    hidden = up.join(gone, "up").where("no > layer_no and (kind = 'gone' or up <> path)").select("path").distinct()
    return files.join(hidden, "path", "left_anti").select("path", "content")


def os_release(text) -> tuple:
    """(id, version_id) expressions over the text of an os-release file."""

    def one(k: str):
        return F.regexp_extract(text, f"(?m)^{k}=[\"']?([^\"'\\n]*)", 1)

    return one("ID"), one("VERSION_ID")


def dpkg(status: DataFrame) -> DataFrame:
    """(name, version, arch) of a dpkg status text (column text): installed packages; no Status counts as installed."""
    s = status.select(F.explode(F.split("text", "\n\n+")).alias("s"))

    def one(k: str):
        return F.regexp_extract("s", f"(?m)^{k}: *(.*)$", 1)

    rows = s.select(one("Package").alias("name"), one("Version").alias("version"), one("Architecture").alias("arch"), one("Status").alias("status"))
    return rows.where("name <> '' and (status = '' or status like '% installed')").drop("status")


def apk(installed: DataFrame) -> DataFrame:
    s = installed.select(F.explode(F.split("text", "\n\n+")).alias("s"))

    def one(k: str):
        return F.regexp_extract("s", f"(?m)^{k}:(.*)$", 1)

    return s.select(one("P").alias("name"), one("V").alias("version"), one("A").alias("arch")).where("name <> ''")


def rpm_header(blob: bytes) -> tuple[str, str, str] | None:
    """(name, [epoch:]version-release, arch) of a header: an index of 16-byte entries, then their data."""
    if len(blob) < 8:
        return None
    n, size = struct.unpack(">II", blob[:8])
    data = blob[8 + 16 * n : 8 + 16 * n + size]
    if n > 65536 or len(data) < size:
        return None
    got: dict[int, object] = {}
    for i in range(n):
        tag, kind, at, count = struct.unpack(">IIII", blob[8 + 16 * i : 24 + 16 * i])
        if tag in (1000, 1001, 1002, 1022) and kind in (6, 9) and at < size:
            got[tag] = data[at : data.find(b"\0", at) if b"\0" in data[at:] else size].decode("utf-8", "replace")
        elif tag == 1003 and kind == 4 and count and at + 4 <= size:
            got[tag] = struct.unpack(">I", data[at : at + 4])[0]
    if 1000 not in got or 1001 not in got:
        return None
    epoch = f"{got[1003]}:" if got.get(1003) else ""
    release = f"-{got[1002]}" if got.get(1002) else ""
    return str(got[1000]), f"{epoch}{got[1001]}{release}", str(got.get(1022, ""))


def rpm_sqlite(data: bytes) -> list[tuple[str, str, str]]:
    """Packages of an rpmdb.sqlite file, by name, each once."""
    if data[:16] != b"SQLite format 3\0":
        return []
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    rows = {r for (b,) in db.execute("select blob from Packages") if (r := rpm_header(b))}
    return sorted(rows)


# Where an image keeps its package database, in the order in which they count.
DATABASES = (
    ("dpkg", "var/lib/dpkg/status"),
    ("apk", "lib/apk/db/installed"),
    ("rpm", "var/lib/rpm/rpmdb.sqlite"),
    ("rpm", "usr/lib/sysimage/rpm/rpmdb.sqlite"),
    ("legacy_rpm", "var/lib/rpm/Packages"),
)


def os_database(files: DataFrame) -> DataFrame:
    """(kind, path, content) of the one database that counts; kind legacy_rpm can't be read and makes a scan partial.
    files: path, content."""
    rank = F.coalesce(*(F.when(F.col("path") == p, F.lit(i)) for i, (_, p) in enumerate(DATABASES)))
    kinds = F.array(*(F.lit(k) for k, _ in DATABASES))
    return files.select(rank.alias("rank"), "path", "content").where("rank is not null").orderBy("rank").limit(1).select(F.get(kinds, F.col("rank")).alias("kind"), "path", "content")
