"""Orderings, hashes, paths and parsers, without Spark where it isn't needed."""

import itertools
import json

import pytest

from vetstone.functions import hashing, net, paths
from vetstone.functions import versions as V
from vetstone.sources import lockfiles


def test_blake3_known_answers():
    assert hashing.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({hashing.blake3(bytes(n)) for n in (1023, 1024, 1025, 2048, 2049, 5000)}) == 6
    assert hashing.finding_id("a", "bc", "", "") != hashing.finding_id("a", "b", "c", "")


@pytest.mark.parametrize(
    ("scheme", "ordered"),
    [
        ("semver", ["bad", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2.0", "1.10.0"]),
        ("pep440", ["1.0.dev1", "1.0a1", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.1", "1!0.1"]),
        ("debian", ["1.0~rc1", "1.0", "1.0-1", "1.0-2", "1.0a", "1.2", "1:0.1"]),
        ("rpm", ["1.0~rc1-1", "1.0-1", "1.0-2", "1.0^git1-1", "1.0.1-1", "1.10-1", "1:0.1-1"]),
        ("apk", ["1.0_alpha1", "1.0_rc1", "1.0", "1.0-r1", "1.0_p1", "1.0a", "1.0.1"]),
        ("gems", ["1.0.a", "1.0.beta", "1", "1.0.1", "1.10"]),
        ("composer", ["dev-main", "1.0-alpha1", "1.0-beta1", "1.0-RC1", "1.0", "1.0-p1", "1.1"]),
        ("maven", ["1-alpha", "1-beta", "1-milestone", "1-rc", "1-snapshot", "1", "1-sp", "1.1"]),
        ("generic", ["1.2", "1.10", "2"]),
    ],
)
def test_orderings(scheme, ordered):
    for (i, a), (j, b) in itertools.product(enumerate(ordered), repeat=2):
        assert V.compare(scheme, a, b) == (i > j) - (i < j), (a, b)


def test_equal_versions():
    assert V.compare("gems", "1", "1.0") == 0 and V.compare("maven", "1", "1.0-ga") == 0 and V.compare("pep440", "1.0", "1") == 0


def test_ranges():
    events = [{"introduced": "0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0"}, {"last_affected": "2.3.0"}]
    inside = [v for v in ("0.1.0", "1.1.9", "1.2.0", "1.9.0", "2.0.0", "2.3.0", "2.3.1") if V.in_range("semver", v, events)]
    assert inside == ["0.1.0", "1.1.9", "2.0.0", "2.3.0"]
    assert V.lowest_fix("semver", "1.0.0", [{"events": events}, {"events": [{"fixed": "1.1.0"}]}]) == "1.1.0"


def test_globs():
    import re

    hit = lambda g, p, c=True: bool(re.search(paths.glob_regex(g, c), p))
    assert hit("*.min.js", "dist/app.min.js") and not hit("*.min.js", "dist/app.min.js", False)
    assert hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b") and hit("[ab].{c,d}", "a.d") and not hit("[!a]", "a")


def test_reserved_addresses():
    assert all(map(net.reserved, ["127.0.0.1", "10.1.1.1", "169.254.1.1", "100.64.0.1", "::1", "::ffff:10.0.0.1", "224.0.0.1", "192.0.2.1", "nonsense"]))
    assert not any(map(net.reserved, ["8.8.8.8", "2606:4700:4700::1111"]))


FILES = {
    "Cargo.lock": ('[[package]]\nname = "a"\nversion = "1.0.0"\n', [("a", "1.0.0", False)]),
    "package-lock.json": (json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}}), [("a", "1", True), ("@s/b", "2", False)]),
    "requirements.txt": ("a==1.0 # x\n-r other\nb>=2\nc[x]==3 ; python_version>'3'\n", [("a", "1.0", True), ("b", None, True), ("c", "3", True)]),
    "uv.lock": ('[[package]]\nname = "me"\nsource = { editable = "." }\ndependencies = [{ name = "a" }]\n[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\n', [("a", "1", True), ("b", "2", False)]),
    "yarn.lock": ('"@s/a@^1.0", "@s/a@^1.1":\n  version "1.2"\n\nb@2:\n  version "2.0"\n', [("@s/a", "1.2", False), ("b", "2.0", False)]),
    "pnpm-lock.yaml": ("packages:\n  /a@1.0.0(x@2):\n    x: 1\n  /b/2.0.0:\n    x: 1\n", [("a", "1.0.0", False), ("b", "2.0.0", False)]),
    "go.sum": ("m v1.0.0 h1:x\nm v1.0.0/go.mod h1:y\n", [("m", "1.0.0", False)]),
    "poetry.lock": ('[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "l"\nversion = "1"\n[package.source]\ntype = "directory"\n', [("a", "1", False)]),
    "Gemfile.lock": ("GEM\n  specs:\n    a (1.0-java)\n      b (>= 1)\n    b (2.0)\nPATH\n  specs:\n    l (1)\nDEPENDENCIES\n  a\n", [("a", "1.0", True), ("b", "2.0", False)]),
    "composer.lock": (json.dumps({"packages": [{"name": "a/b", "version": "v1.0"}], "packages-dev": [{"name": "c/d", "version": "2"}]}), [("a/b", "1.0", False), ("c/d", "2", False)]),
    "gradle.lockfile": ("# x\ng:a:1.0=conf\nempty=\n", [("g:a", "1.0", False)]),
    "pom.xml": ("<!-- <dependency><groupId>x</groupId><artifactId>x</artifactId></dependency> --><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><version>${v}</version></dependency>", [("g:a", "1", True), ("g:b", None, True)]),
    "package.json": (json.dumps({"dependencies": {"a": "1.2.3", "b": "^1.0", "c": "file:x"}}), [("a", "1.2.3", True), ("b", None, True)]),
    "pyproject.toml": ('[project]\ndependencies = ["a==1.0", "b>=2"]\n[tool.poetry.dependencies]\npython = "^3"\nc = "1.5"\nd = { path = "x" }\n', [("a", "1.0", True), ("b", None, True), ("c", "1.5", True)]),
    "go.mod": ("module x\nrequire (\n\ta v1.0.0\n\tb v2.0.0 // indirect\n)\nexclude c v1.0.0\nrequire d v3.0.0\n", [("a", "1.0.0", True), ("b", "2.0.0", False), ("d", "3.0.0", True)]),
    "Gemfile": ("gem 'a', '1.0'\ngem 'b', '~> 2'\ngem 'c', path: 'x'\n", [("a", "1.0", True), ("b", None, True)]),
    "composer.json": (json.dumps({"require": {"php": "8", "ext-x": "*", "a/b": "1.0", "c/d": "^2"}}), [("a/b", "1.0", True), ("c/d", None, True)]),
    "Cargo.toml": ('[dependencies]\na = "=1.0"\nb = "1"\nc = { path = "x" }\nd = { version = "=2", package = "e" }\n', [("a", "1.0", True), ("b", None, True), ("e", "2", True)]),
}


@pytest.mark.parametrize("name", FILES)
def test_lockfiles(name):
    text, want = FILES[name]
    got, reason = lockfiles.parse(name, text)
    assert reason is None and [(x[2], x[3], x[4]) for x in got] == want
    if name not in ("requirements.txt", "yarn.lock", "go.sum", "Gemfile.lock", "gradle.lockfile", "pom.xml", "go.mod", "Gemfile"):
        assert lockfiles.parse(name, "{[")[1]


def test_blake3_of_many_rows():
    from vetstone.functions.hashing import blake3, blake3_many, structural_hash

    rows = [(bytes(range(251)) * 13)[:n] for n in (0, 1, 63, 64, 65, 128, 200, 1023, 1024, 1025, 3000, 5)]
    assert blake3_many(rows) == [blake3(r) for r in rows] and blake3_many([]) == []
    assert structural_hash([("call", "f")]) != structural_hash([("callf", "")]) and len(structural_hash([])) == 27


def test_pnpm_keys():
    from vetstone.sources.lockfiles import pnpm_key

    assert [pnpm_key(k) for k in ("string_decoder@1.1.1", "/string_decoder@1.3.0", "/@s/a@1.0.0(p@2)", "@s/a@1.0.0_p@2", "/@babel/core/7.1.0_x@1", "/foo/1.0.0", "x")] == [("string_decoder", "1.1.1"), ("string_decoder", "1.3.0"), ("@s/a", "1.0.0"), ("@s/a", "1.0.0"), ("@babel/core", "7.1.0"), ("foo", "1.0.0"), None]


def test_ed25519_known_answers():
    """RFC 8032, section 7.1, tests 1 and 2."""
    from vetstone.functions import ed25519

    for seed, key, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        seed, key, message, signature = (bytes.fromhex(x) for x in (seed, key, message, signature))
        assert ed25519.public_key(seed) == key and ed25519.sign(seed, message) == signature and ed25519.verify(key, message, signature)
        assert not ed25519.verify(key, message + b"x", signature) and not ed25519.verify(key, message, signature[:-1] + b"\xff") and not ed25519.verify(b"", message, signature)


def test_bundles():
    from vetstone.functions import ed25519
    from vetstone.sources import bundles

    seed = bytes(range(32))
    data = bundles.export({"snapshot_id": "s"}, {"kev.json": b"{}", "a/b": b"x" * 1000}, seed)
    manifest, files = bundles.read(data, ed25519.public_key(seed))
    assert manifest["snapshot_id"] == "s" and files == {"kev.json": b"{}", "a/b": b"x" * 1000}
    with pytest.raises(ValueError):
        bundles.read(data, ed25519.public_key(bytes(32)))


def test_config(tmp_path):
    from vetstone.sources import config

    (tmp_path / "a/b").mkdir(parents=True)
    assert config.load(str(tmp_path / "a/b"))["format"] == "table"
    (tmp_path / "vetstone.toml").write_text('format = "json"\nexclude = ["x"]\n[[suppressions]]\nrule_id = "r"\nreason = "known"\nexpires = "2030-01-01"\n')
    c = config.load(str(tmp_path / "a/b"), format=None, offline=True)
    assert (c["format"], c["exclude"], c["offline"], c["max_feed_age"]) == ("json", ["x"], True, "7d") and config.load(str(tmp_path), format="sarif")["format"] == "sarif"
    for bad in ("colour = 1", '[[suppressions]]\nrule_id = "r"\n'):
        with pytest.raises(ValueError):
            config.parse(bad)
