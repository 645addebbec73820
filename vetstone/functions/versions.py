"""Orderings of version strings.

Where an ordering has keys, a version becomes an array of (tag, number, text) that Spark compares natively; Maven and
generic versions depend on what they are compared with, and are compared in pairs. A version that can't be read sorts
below all that can.
"""

from __future__ import annotations

import functools
import re
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = T.ArrayType(T.StructType([T.StructField("tag", T.IntegerType()), T.StructField("num", T.LongType()), T.StructField("txt", T.StringType())]))
SCHEMES = {
    "semver": ("crates.io", "npm", "Go"),
    "pep440": ("PyPI",),
    "debian": ("Debian", "Ubuntu"),
    "apk": ("Alpine",),
    "rpm": ("Red Hat", "Rocky Linux", "AlmaLinux", "openSUSE", "SUSE", "Fedora"),
    "gems": ("RubyGems",),
    "composer": ("Packagist",),
    "maven": ("Maven",),
}
_MAX = 2**63 - 1


def scheme(ecosystem: Column) -> Column:
    base = F.split_part(ecosystem, F.lit(":"), F.lit(1))
    out = F.lit("generic")
    for name, ecosystems in SCHEMES.items():
        out = F.when(base.isin(*ecosystems), name).otherwise(out)
    return out


def scheme_of(ecosystem: str) -> str:
    base = ecosystem.split(":")[0]
    return next((k for k, v in SCHEMES.items() if base in v), "generic")


def _num(s: str) -> int:
    return n if s and (n := int(s)) <= _MAX else 0


def semver(v: str) -> list[tuple]:
    m = re.fullmatch(r"v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", v)
    if not m or any(int(x) > _MAX for x in m.groups()[:3]):
        raise ValueError(v)
    key = [(0, _num(x), "") for x in m.groups()[:3]]
    if not m[4]:
        return [*key, (1, 0, "")]
    return [*key, (0, 0, ""), *((0, _num(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split("."))]


@functools.lru_cache(1 << 16)
def semver_text(v: str) -> str:
    """semver()'s key as a text of the same order: 19 digits for a number, a space after a text."""
    try:
        key = semver(v)
    except ValueError:
        return "0" + v
    return "1" + "".join(f"{tag}{num:019}{txt} " for tag, num, txt in key)


def semver_text_of(version: Column) -> Column:
    """semver_text() of a column, natively. Most versions are three numbers: only others are taken apart by a pattern."""
    number = lambda tag, x: F.concat(F.lit(str(tag)), F.lpad(x.cast("string"), 19, "0"), F.lit(" "))
    pattern = r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
    parts = [F.regexp_extract(version, pattern, i).try_cast("long") for i in (1, 2, 3)]
    pre = F.regexp_extract(version, pattern, 4)

    def part(x: Column) -> Column:
        return F.when(x.rlike("^[0-9]+$"), number(0, F.coalesce(x.try_cast("long"), F.lit(0)))).otherwise(F.concat(F.lit(f"1{0:019}"), x, F.lit(" ")))

    rest = F.when(pre == "", F.lit(f"1{0:019} ")).otherwise(F.concat(F.lit(f"0{0:019} "), F.array_join(F.transform(F.split(pre, "[.]"), part), "")))
    plain = F.concat(F.lit("1"), *(number(0, F.split_part(version, F.lit("."), F.lit(i)).try_cast("long")) for i in (1, 2, 3)), F.lit(f"1{0:019} "))
    other = F.concat(F.lit("1"), *(number(0, x) for x in parts), rest)
    return F.coalesce(F.when(version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"), plain).otherwise(other), F.concat(F.lit("0"), version))


def pep440(v: str) -> list[tuple]:
    from packaging.version import InvalidVersion, Version

    try:
        p = Version(v)
    except InvalidVersion as e:
        raise ValueError(v) from e
    release = list(p.release)
    while len(release) > 1 and not release[-1]:
        release.pop()
    key = [(0, p.epoch, "")] + [(1, n, "") for n in release] + [(0, 0, "")]
    # before: development release of the version itself, then pre-releases, then the release
    if p.pre is None and p.post is None and p.dev is not None:
        pre = (-1, 0, "")
    else:
        pre = (0, p.pre[1], p.pre[0]) if p.pre else (1, 0, "")
    # the letter decides before the number
    key += [(pre[0], 0, pre[2]), (0, pre[1], "")]
    key += [(0, -1 if p.post is None else p.post, ""), (0, _MAX if p.dev is None else p.dev, "")]
    for x in re.split(r"[._-]", p.local) if p.local else []:
        key.append((2, int(x), "") if x.isdigit() else (1, 0, x))
    return key


def _alternating(s: str, order) -> list[tuple]:
    """Debian's scheme: text and number parts in turn, text by a character order in which the end is not lowest."""
    out = []
    while s:
        text = re.match(r"\D*", s)[0]
        number = re.match(r"\d*", s[len(text) :])[0]
        out += [(order(c), 0, "") for c in text] + [(0, 0, "")] + [(0, _num(number), "")]
        s = s[len(text) + len(number) :]
    return [*out, (0, 0, ""), (0, 0, "")]


def debian(v: str) -> list[tuple]:
    if not v or not re.fullmatch(r"(?:\d+:)?[0-9A-Za-z.+:~-]+", v):
        raise ValueError(v)
    epoch, _, rest = v.rpartition(":") if ":" in v else ("0", "", v)
    upstream, _, revision = rest.rpartition("-") if "-" in rest else (rest, "", "0")

    def order(c: str) -> int:
        return -1 if c == "~" else ord(c) if c.isalpha() else ord(c) + 256

    return [(0, _num(epoch), ""), *_alternating(upstream, order), (-2, 0, ""), *_alternating(revision, order)]


def rpm(v: str) -> list[tuple]:
    epoch, colon, rest = v.partition(":")
    if not colon:
        epoch, rest = "0", v
    version, _, release = rest.rpartition("-") if "-" in rest else (rest, "", "")
    if not version:
        raise ValueError(v)

    def part(s: str) -> list[tuple]:
        # a tilde is below the end, a caret above it but below any segment; numbers are above letters
        out = []
        for x in re.findall(r"\d+|[A-Za-z]+|~|\^", s):
            out.append((-2, 0, "") if x == "~" else (0, 0, "") if x == "^" else (2, _num(x), "") if x.isdigit() else (1, 0, x))
        return [*out, (-1, 0, "")]

    return [(0, _num(epoch), ""), *part(version), *part(release)]


_APK = {"alpha": 0, "beta": 1, "pre": 2, "rc": 3, "cvs": 5, "svn": 6, "git": 7, "hg": 8, "p": 9}


def apk(v: str) -> list[tuple]:
    m = re.fullmatch(r"(\d+(?:\.\d+)*)([a-z]?)((?:_(?:alpha|beta|pre|rc|cvs|svn|git|hg|p)\d*)*)(?:-r(\d+))?", v)
    if not m:
        raise ValueError(v)
    key = [(1, _num(x), "") for x in m[1].split(".")] + [(0, 0, m[2])]
    suffixes = re.findall(r"_([a-z]+)(\d*)", m[3])
    for name, n in [*suffixes, *[("", "")] * (8 - len(suffixes))]:
        key += [(0, _APK.get(name, 4), ""), (0, _num(n), "")]
    return [*key, (0, _num(m[4] or ""), "")]


WIDTH = 16


def gems(v: str) -> list[tuple]:
    parts = re.findall(r"\d+|[A-Za-z]+", v.strip().replace("-", ".pre."))
    if not parts or not re.fullmatch(r"\s*[0-9A-Za-z.-]+\s*", v):
        raise ValueError(v)
    key = [(1, _num(x), "") if x.isdigit() else (0, 0, x) for x in parts]
    return key + [(1, 0, "")] * (WIDTH - len(key))


_STABILITY = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "rc": 3, "": 4, "stable": 4, "patch": 5, "pl": 5, "p": 5}


def composer(v: str) -> list[tuple]:
    s = v.strip().lower().removeprefix("v").split("+")[0]
    if s.startswith("dev-"):
        return [(-1, 0, s)]
    m = re.fullmatch(r"(\d+(?:\.\d+)*)(?:[._-]?(dev|alpha|a|beta|b|rc|stable|patch|pl|p)[.-]?(\d*))?", s)
    if not m:
        raise ValueError(v)
    numbers = [(0, _num(x), "") for x in m[1].split(".")]
    return [*numbers, *[(0, 0, "")] * (WIDTH - len(numbers)), (0, _STABILITY[m[2] or ""], ""), (0, _num(m[3] or ""), "")]


KEYS = {"semver": semver, "pep440": pep440, "debian": debian, "rpm": rpm, "apk": apk, "gems": gems, "composer": composer}


def key(scheme_name: str, version: str | None) -> list[tuple] | None:
    """The sort key, None for the schemes without one."""
    if version is None or scheme_name not in KEYS:
        return None
    try:
        return [(1, 0, ""), *KEYS[scheme_name](version)]
    except ValueError:
        return [(-1, 0, version)]


@F.udf(KEY, useArrow=True)
def key_udf(scheme_name, version):
    return key(scheme_name, version)


_QUALIFIER = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "milestone": 2, "m": 2, "rc": 3, "cr": 3, "pre": 4, "snapshot": 5, "": 6, "ga": 6, "final": 6, "release": 6, "sp": 7}


def maven(a: str, b: str) -> int:
    def tokens(v):
        out = [x for x in re.findall(r"\d+|[a-z]+", v.lower()) if x not in ("ga", "final", "release")]
        while out and out[-1].isdigit() and not int(out[-1]):
            out.pop()
        return out

    def order(x, other):
        if x is None:
            return (1, 0, "") if other.isdigit() else (0, 6, "")
        if x.isdigit():
            return (1, int(x), "")
        return (0, _QUALIFIER.get(x, 8), x if x not in _QUALIFIER else "")

    for x, y in zip_longest(tokens(a), tokens(b)):
        p, q = order(x, y), order(y, x)
        if p != q:
            return -1 if p < q else 1
    return 0


def generic(a: str, b: str) -> int:
    split = functools.partial(re.split, r"[.\-+_~]")
    for x, y in zip_longest(split(a), split(b), fillvalue="0"):
        p, q = (int(x), int(y)) if x.isdigit() and y.isdigit() else (x, y)
        if p != q:
            return -1 if p < q else 1
    return 0


def compare(scheme_name: str, a: str, b: str) -> int:
    """-1, 0 or 1."""
    if scheme_name == "maven":
        return maven(a, b)
    if scheme_name not in KEYS:
        return generic(a, b)
    x, y = key(scheme_name, a), key(scheme_name, b)
    return (x > y) - (x < y)


BOUNDS = ("introduced", "fixed", "last_affected")


def in_range(scheme_name: str, version: str, events: list[dict]) -> bool:
    """Whether a version lies in a range: bounds in order, each switching the verdict."""
    bounds = [(e[k], k) for e in events or [] for k in BOUNDS if e.get(k)]

    def order(p, q):
        zero = (p[0] != "0") - (q[0] != "0")
        return zero if p[0] == "0" or q[0] == "0" else compare(scheme_name, p[0], q[0])

    inside = False
    for bound, kind in sorted(bounds, key=functools.cmp_to_key(order)):
        c = 1 if bound == "0" else compare(scheme_name, version, bound)
        if kind == "introduced" and c >= 0:
            inside = True
        elif kind == "fixed" and c >= 0 or kind == "last_affected" and c > 0:
            inside = False
    return inside


def lowest_fix(scheme_name: str, version: str, ranges: list[dict]) -> str | None:
    """The least fixed version above this one, over all ranges of the entry."""
    fixes = [e["fixed"] for r in ranges or [] for e in r.get("events") or [] if e.get("fixed") and compare(scheme_name, e["fixed"], version) > 0]
    return min(fixes, key=functools.cmp_to_key(lambda a, b: compare(scheme_name, a, b)), default=None)


@F.pandas_udf(T.IntegerType())
def compare_udf(scheme_name: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([compare(*x) for x in zip(scheme_name, a, b, strict=True)], dtype="int32")
