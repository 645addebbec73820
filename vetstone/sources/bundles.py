"""Signed bundles of a feed snapshot, for machines without a network: one compressed archive."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile

import zstandard

from vetstone.functions import ed25519

LEVEL, MOST_FILES, MOST_BYTES = 19, 10_000, 4 * 1024**3


def export(manifest: dict, files: dict[str, bytes], seed: bytes) -> bytes:
    """MANIFEST, SIGNATURE, SIGNER.pub and files/*, in this order. The manifest names each file's digest."""
    digests = {k: "sha256:" + hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}
    head = json.dumps(manifest | {"files": digests}, sort_keys=True).encode()
    members = {"MANIFEST": head, "SIGNATURE": ed25519.sign(seed, head), "SIGNER.pub": ed25519.public_key(seed)} | {f"files/{k}": files[k] for k in digests}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw.getvalue())


def read(data: bytes, trusted: bytes) -> tuple[dict, dict[str, bytes]]:
    """(manifest, files) of a bundle; ValueError if it isn't the trusted signer's, names a path outside, is too large or
    holds other files than its manifest says."""
    members: dict[str, bytes] = {}
    total = 0
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
        for m in tar:
            total += m.size
            if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                raise ValueError(f"not a file of a bundle: {m.name}")
            if len(members) >= MOST_FILES or total > MOST_BYTES:
                raise ValueError("the bundle is too large")
            members[m.name] = tar.extractfile(m).read()
    head = members.get("MANIFEST", b"")
    if members.get("SIGNER.pub") != trusted or not ed25519.verify(trusted, head, members.get("SIGNATURE", b"")):
        raise ValueError("the bundle isn't signed by the trusted key")
    manifest = json.loads(head)
    files = {k.removeprefix("files/"): v for k, v in members.items() if k.startswith("files/")}
    if {k: "sha256:" + hashlib.sha256(v).hexdigest() for k, v in files.items()} != manifest["files"]:
        raise ValueError("the files differ from the manifest")
    return manifest, files
