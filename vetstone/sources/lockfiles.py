"""Lock files and manifests to packages: one parser for each format behind a dispatcher by file name."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGES = T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n == "direct" else T.StringType()) for n in ("ecosystem", "purl_type", "name", "version", "direct")]))
#: Manifest -> the lock files that stand for it, in its directory or above.
SHADOWS = {
    "package.json": ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml"],
    "pyproject.toml": ["poetry.lock", "uv.lock"],
    "go.mod": ["go.sum"],
    "Gemfile": ["Gemfile.lock"],
    "composer.json": ["composer.lock"],
    "Cargo.toml": ["Cargo.lock"],
}
_KIND = {"npm": "npm", "PyPI": "pypi", "crates.io": "cargo", "Go": "golang", "RubyGems": "gem", "Packagist": "composer", "Maven": "maven"}
_BARE = re.compile(r"v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?")


def _p(ecosystem: str, name: str, version: str | None, direct: bool) -> tuple:
    return ecosystem, _KIND[ecosystem], name, version, direct


def cargo_lock(text):
    return [_p("crates.io", x["name"], x.get("version"), False) for x in tomllib.loads(text).get("package", [])]


def package_lock(text):
    doc = json.loads(text)
    out = []
    for path, x in (doc.get("packages") or {}).items():
        if path and "node_modules/" in path:
            out.append(_p("npm", path.rsplit("node_modules/", 1)[1], x.get("version"), path.count("node_modules/") == 1))
    if not out:
        out = [_p("npm", k, x.get("version"), True) for k, x in (doc.get("dependencies") or {}).items()]
    return out


def requirements(text):
    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line or line.startswith("-"):
            continue
        if "==" in line:
            name, _, version = line.partition("==")
            version = (version.split() or [None])[0]
        else:
            name, version = re.split(r"[<>=!~;\s\[@]", line)[0], None
        name = name.split("[")[0].strip()
        if name:
            out.append(_p("PyPI", name, version, True))
    return out


def uv_lock(text):
    rows = tomllib.loads(text).get("package", [])
    local = lambda x: any(k in x.get("source", {}) for k in ("virtual", "editable", "directory", "path"))
    named = set()
    for x in filter(local, rows):
        groups = [x.get("dependencies", []), *x.get("dev-dependencies", {}).values(), *x.get("optional-dependencies", {}).values()]
        named |= {d["name"] for g in groups for d in g}
    return [_p("PyPI", x["name"], x.get("version"), x["name"] in named) for x in rows if not local(x)]


def yarn_lock(text):
    out = []
    if "__metadata:" in text:
        import yaml

        for key, x in (yaml.safe_load(text) or {}).items():
            first = key.split(",")[0].strip()
            if key != "__metadata" and "@workspace:" not in first and (at := first.rfind("@")) > 0:
                name = first[: first.find("@", 1)] if "@npm:" in first else first[:at]
                out.append(_p("npm", name, str(x.get("version")) if x.get("version") is not None else None, False))
        return out
    name = None
    for line in text.splitlines():
        if line and not line[0].isspace() and not line.startswith("#"):
            first = line.rstrip(":").split(",")[0].strip().strip('"')
            name = first[:at] if (at := first.rfind("@")) > 0 else None
        elif name and (m := re.match(r'\s+version:?\s+"?([^"\s]+)', line)):
            out.append(_p("npm", name, m[1], False))
            name = None
    return out


def pnpm_key(key: str) -> tuple[str, str] | None:
    """Name and version of a key: name@version, /name@version(peer@1), or /name/version_peer@1 in old files."""
    key = key.strip().lstrip("/").partition("(")[0]
    old = re.fullmatch(r"(.+)/(\d[^/]*)", key)
    new = re.fullmatch(r"(.+)@([^@]*)", key)
    name, version = old.groups() if old else new.groups() if new else ("", "")
    version = version.partition("_")[0]
    if not old and new and "_" in key[1:].partition("@")[2]:  # a peer's @ comes after the version's
        name, version = key[: (at := key.index("@", 1))], key[at + 1 :].partition("_")[0]
    return (name, version) if name and version else None


def pnpm_lock(text):
    import yaml

    doc = yaml.safe_load(text) or {}
    return [_p("npm", *found, False) for key in doc.get("packages") or doc.get("snapshots") or {} if (found := pnpm_key(str(key)))]


def go_sum(text):
    rows = dict.fromkeys((p[0], p[1].removesuffix("/go.mod").removeprefix("v")) for p in map(str.split, text.splitlines()) if len(p) >= 2)
    return [_p("Go", name, version, False) for name, version in rows]


def poetry_lock(text):
    return [_p("PyPI", x["name"], x.get("version"), False) for x in tomllib.loads(text).get("package", []) if x.get("source", {}).get("type") not in ("directory", "file")]


def gemfile_lock(text):
    section, specs, direct = "", [], set()
    for line in text.splitlines():
        if line and not line[0].isspace():
            section = line.strip()
        elif section in ("GEM", "GIT") and (m := re.match(r" {4}(\S+) \(([^)]*)\)", line)):
            specs.append((m[1], m[2].split("-")[0]))
        elif section == "DEPENDENCIES" and (m := re.match(r"  ([^\s!(]+)", line)):
            direct.add(m[1])
    return [_p("RubyGems", n, v, n in direct) for n, v in specs]


def composer_lock(text):
    doc = json.loads(text)
    return [_p("Packagist", x["name"], (x.get("version") or "").removeprefix("v") or None, False) for k in ("packages", "packages-dev") for x in doc.get(k) or []]


def gradle_lock(text):
    rows = (line.split("=")[0].split(":") for line in text.splitlines() if line.strip() and not line.startswith("#") and not line.startswith("empty="))
    return [_p("Maven", f"{r[0]}:{r[1]}", r[2], False) for r in rows if len(r) == 3 and all(r)]


def pom(text, most=100_000):
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    out = []
    for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S)[:most]:
        tag = {k: (m[1].strip() if (m := re.search(f"<{k}>(.*?)</{k}>", block, re.S)) else None) for k in ("groupId", "artifactId", "version")}
        if tag["groupId"] and tag["artifactId"]:
            v = tag["version"]
            out.append(_p("Maven", f"{tag['groupId']}:{tag['artifactId']}", None if not v or "$" in v or v[0] in "[(" else v, True))
    return out


def package_json(text):
    doc = json.loads(text)
    away = ("file:", "link:", "workspace:", "git", "http", "github:")
    return [
        _p("npm", name, v if _BARE.fullmatch(v) else None, True)
        for k in ("dependencies", "devDependencies", "optionalDependencies")
        for name, v in (doc.get(k) or {}).items()
        if isinstance(v, str) and not v.startswith(away)
    ]


def _exact(spec: str) -> str | None:
    return m[1] if (m := re.fullmatch(r"\s*={2,3}\s*([0-9][^\s,;*]*)\s*", spec)) else None


def pyproject(text):
    doc = tomllib.loads(text)
    out = []
    project = doc.get("project", {})
    for d in [*project.get("dependencies", []), *(x for g in project.get("optional-dependencies", {}).values() for x in g)]:
        if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*)", d):
            out.append(_p("PyPI", m[1], _exact(m[2]), True))
    poetry = doc.get("tool", {}).get("poetry", {})
    for g in [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(x.get("dependencies", {}) for x in poetry.get("group", {}).values())]:
        for name, v in g.items():
            if name == "python" or isinstance(v, dict) and any(k in v for k in ("path", "git", "url")):
                continue
            v = v.get("version", "") if isinstance(v, dict) else str(v)
            out.append(_p("PyPI", name, v if re.fullmatch(r"\d[0-9A-Za-z.+-]*", v) else _exact(v), True))
    return out


def go_mod(text):
    out, inside = [], False
    for line in text.splitlines():
        body = line.strip()
        if inside and body == ")":
            inside = False
        elif re.match(r"require\s*\(", body):
            inside = True
        elif inside or body.startswith("require "):
            m = re.match(r"(?:require\s+)?(\S+)\s+v(\S+)", body)
            if m and not body.startswith("//"):
                out.append(_p("Go", m[1], m[2], "// indirect" not in body))
    return out


def gemfile(text):
    out = []
    for m in re.finditer(r"""^\s*gem\s+["']([^"']+)["'](.*)$""", text, re.M):
        if re.search(r"\b(?:path|git|github)\s*(?::|=>)|:(?:path|git|github)\s*=>", m[2]):
            continue
        v = re.match(r"""\s*,\s*["']([^"']+)["']""", m[2])
        out.append(_p("RubyGems", m[1], v[1] if v and re.fullmatch(r"\d[0-9A-Za-z.]*", v[1]) else None, True))
    return out


def composer_json(text):
    doc = json.loads(text)
    return [
        _p("Packagist", name, v if re.fullmatch(r"[0-9.]+", v) else None, True)
        for k in ("require", "require-dev")
        for name, v in (doc.get(k) or {}).items()
        if name != "php" and not name.startswith(("ext-", "lib-"))
    ]


def cargo_toml(text):
    doc = tomllib.loads(text)
    out = []
    for k in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, v in doc.get(k, {}).items():
            d = v if isinstance(v, dict) else {"version": v}
            if any(x in d for x in ("path", "git", "workspace")):
                continue
            spec = d.get("version", "")
            out.append(_p("crates.io", d.get("package", name), spec[1:].strip() if spec.startswith("=") else None, True))
    return out


PARSERS = {
    "Cargo.lock": cargo_lock, "package-lock.json": package_lock, "npm-shrinkwrap.json": package_lock, "requirements.txt": requirements, "uv.lock": uv_lock,
    "yarn.lock": yarn_lock, "pnpm-lock.yaml": pnpm_lock, "go.sum": go_sum, "poetry.lock": poetry_lock, "Gemfile.lock": gemfile_lock, "composer.lock": composer_lock,
    "gradle.lockfile": gradle_lock, "pom.xml": pom, "package.json": package_json, "pyproject.toml": pyproject, "go.mod": go_mod, "Gemfile": gemfile,
    "composer.json": composer_json, "Cargo.toml": cargo_toml,
}
RESULT = T.StructType([T.StructField("packages", PACKAGES), T.StructField("reason", T.StringType())])


def parse(name: str, text: str) -> tuple[list[tuple], str | None]:
    """Packages of a file, and why there are none if it can't be read."""
    try:
        return PARSERS[name](text), None
    except Exception as e:  # any malformed file degrades to a reason, never ends the scan
        return [], f"{name}: {type(e).__name__}"


@F.udf(RESULT, useArrow=True)
def parse_udf(name, text):
    return parse(name, text or "")


def unshadowed(files: DataFrame) -> DataFrame:
    """Files (path, name, ...) without manifests whose lock file is in their directory or above: an anti join."""
    from vetstone.functions.paths import ancestors

    shadow = F.lit(None).cast("array<string>")
    for manifest, locks in SHADOWS.items():
        shadow = F.when(F.col("name") == manifest, F.array(*map(F.lit, locks))).otherwise(shadow)
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    asks = files.withColumn("l", F.explode(shadow)).select("path", "l", F.explode(F.when(parent == "", F.array(F.lit(""))).otherwise(ancestors(parent))).alias("dir"))
    locks = files.where(F.col("name").isin(*{x for v in SHADOWS.values() for x in v})).select(F.col("name").alias("l"), parent.alias("dir"))
    return files.join(asks.join(locks, ["l", "dir"], "left_semi").select("path").distinct(), "path", "left_anti")


def packages(files: DataFrame) -> DataFrame:
    """(path, ordinal, ecosystem, purl_type, name, version, direct) of all supported files. files: path, name, text."""
    rows = unshadowed(files.where(F.col("name").isin(*PARSERS))).withColumn("r", parse_udf("name", "text"))
    return rows.select("path", F.posexplode("r.packages").alias("ordinal", "p")).select("path", "ordinal", "p.*")


def reasons(files: DataFrame) -> DataFrame:
    """(path, reason) of the files that couldn't be read."""
    rows = unshadowed(files.where(F.col("name").isin(*PARSERS))).withColumn("r", parse_udf("name", "text"))
    return rows.where("r.reason is not null").select("path", "r.reason")
