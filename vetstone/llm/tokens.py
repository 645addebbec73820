"""Token ids of a public byte-level vocabulary, fast enough for whole corpora.

A text whose white space is single spaces and line feeds between words falls apart at them into chunks (a word with the
space or line feed before it) that the vocabulary's own splitting never joins, so ids are looked up by chunk; a chunk
that is new, and any other text as a whole, goes through the encoder. The encoder is built from the tokenizer's own
JSON file (ranks in order of ids) and gives the same ids.
"""

from __future__ import annotations

import json
import struct

#: Chunks remembered by a worker; the older half goes when there are more.
REMEMBERED = 300_000
#: White space other than space and line feed.
_OTHER = [c for c in map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) if c != "\n"]
_OTHER_ASCII = [c for c in _OTHER if c < "\x80"]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """chunk -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special=self.special, disallowed_special=()) if "<|" in text else self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk if chunk[:1] == "\n" else " " + chunk)
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, 4 bytes each."""
        if not text:
            return b""
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or "\n" in chunks or any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER)):
            return self.encode(text)
        return self.encode(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
