"""Media columns: MPEG audio.

`parse` reads a stream of MPEG-1, 2 and 2.5 frames of layers I to III: it skips ID3v2 tags (with their text frames, if
need be unsynchronised, and their footers), resynchronises on frame headers (a sync word counts only if the header is
valid and another frame, a tag or the end follows where its length says), reads the variable-bitrate table of a Xing,
Info or VBRI frame and holds it against the frames that are there, verifies the 16-bit checksum of protected layer III
frames, and reports exact durations and the byte offset of every frame, so that a reader can seek.

`store` writes any bytes losslessly as such a stream: an ID3v2 tag with their number, a Xing frame with the number of
frames and a table of contents, and protected mono frames with the bytes in their main data. The last frame has the
lowest bitrate that holds the rest.

Null text is empty; rows are independent, so repeated rows and null ids are kept as they come. Very long texts are one
stream each. A stream with garbage gives the frames that can be found; one without any gives zero frames. Extra columns
are left behind by `stored` and kept by `probed`, where those named like its own are an error of Spark's. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.llm.common import string_buffers, table

# Fixed values of the format: kbit/s by index, for MPEG-1 layers I, II, III and for MPEG-2 and 2.5; Hz; samples.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_1 = ((0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), BITRATES)
BITRATES_2 = ((0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), *[(0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)] * 2)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE_MONO, SIDE_STEREO = 17, 32
#: Frames in `store` are protected mono at 32 kHz.
_RATE_INDEX, _HEAD = 2, 4 + 2 + SIDE_MONO


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of protected frames: over the header's last two bytes and the side information."""
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ x]
    return c


class Frame(NamedTuple):
    length: int
    rate: int
    samples: int
    #: Bytes of side information, which the checksum covers; 0 where that isn't layer III's.
    side: int


def frame_of(header: int) -> Frame | None:
    """What a 32-bit header says; None if it isn't one of a frame."""
    version, layer, bitrate, rate = header >> 19 & 3, 4 - (header >> 17 & 3), header >> 12 & 15, header >> 10 & 3
    if header >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or header & 3 == 2:
        return None
    hz = RATES[rate] >> (2, 0, 1, 0)[version]
    first = version == 3
    bits = 1000 * (BITRATES_1 if first else BITRATES_2)[layer - 1][bitrate]
    samples = 384 if layer == 1 else SAMPLES if layer == 2 or first else SAMPLES // 2
    pad = header >> 9 & 1
    length = 4 * (12 * bits // hz + pad) if layer == 1 else samples // 8 * bits // hz + pad
    mono = header >> 6 & 3 == 3
    side = 0 if layer < 3 else (SIDE_MONO if mono else SIDE_STEREO) if first else (9 if mono else 17)
    return Frame(length, hz, samples, side)


def frame_length(header: int) -> int:
    """Bytes of the frame with this 32-bit header; 0 if it isn't one."""
    f = frame_of(header)
    return f.length if f else 0


def _header(bitrate: int, protected: bool = True) -> int:
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | bitrate << 12 | _RATE_INDEX << 10 | 3 << 6


def _frame_head(bitrate: int, side: bytes = bytes(SIDE_MONO)) -> bytes:
    head = struct.pack(">I", _header(bitrate))
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_LENGTHS = [0, *(frame_length(_header(i)) for i in range(1, 15))]
_HEADS = [b"", *(_frame_head(i) for i in range(1, 15))]
_ROOM = _LENGTHS[14] - _HEAD


def store(payload: bytes) -> bytes:
    """The stream that holds these bytes."""
    whole, rest = divmod(len(payload), _ROOM)
    body = np.empty((whole, _LENGTHS[14]), np.uint8)
    body[:, :_HEAD] = np.frombuffer(_HEADS[14], np.uint8)
    body[:, _HEAD:] = np.frombuffer(payload, np.uint8, whole * _ROOM).reshape(whole, _ROOM)
    last = b""
    if rest:
        bitrate = next(i for i in range(1, 15) if _LENGTHS[i] - _HEAD >= rest)
        last = _HEADS[bitrate] + payload[whole * _ROOM :] + bytes(_LENGTHS[bitrate] - _HEAD - rest)
    frames = whole + bool(rest)
    size = body.size + len(last)
    xing_length = _LENGTHS[5]
    total = xing_length + size
    toc = bytes(min(255, (xing_length + min(i * frames // 100 * _LENGTHS[14], size)) * 256 // total) for i in range(100))
    xing = _HEADS[5] + b"Xing" + struct.pack(">III", 7, frames, total) + toc
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    n = len(tag)
    size7 = bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    return b"ID3\x03\x00\x00" + size7 + tag + xing + bytes(xing_length - len(xing)) + body.tobytes() + last


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio may begin, and the text frames of ID3v2 tags before it."""
    at, out = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        n = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        tag = data[at + 10 : at + 10 + n]
        wide, flags = data[at + 3] >= 4, data[at + 5]  # version 2.4 counts in 7-bit bytes
        if flags & 0x80:  # unsynchronised: no byte of 255 stands before a sync's second one
            tag = tag.replace(b"\xff\x00", b"\xff")
        i = 0
        while i + 10 <= len(tag) and tag[i : i + 4].isalnum():
            size = int.from_bytes(tag[i + 4 : i + 8], "big")
            if wide:
                size = tag[i + 4] << 21 | tag[i + 5] << 14 | tag[i + 6] << 7 | tag[i + 7]
            body = tag[i + 10 : i + 10 + size]
            if tag[i : i + 1] == b"T" and body:
                parts = body[1:].decode("utf-16" if body[0] in (1, 2) else "utf-8" if body[0] == 3 else "latin-1", "replace").split("\0")
                key = tag[i : i + 4].decode("latin-1")
                out[f"{key}:{parts[0]}" if key == "TXXX" and len(parts) > 1 else key] = parts[1] if key == "TXXX" and len(parts) > 1 else parts[0]
            i += 10 + size
        at += 10 + n + (10 if flags & 0x10 else 0)  # a footer repeats the header
    return at, out


def _table(data: bytes, at: int, head: int) -> dict | None:
    """The variable-bitrate table in the frame at a place, if it has one: frames, bytes and toc as far as it names them."""
    i = at + head
    if data[i : i + 4] in (b"Xing", b"Info"):
        flags, out = int.from_bytes(data[i + 4 : i + 8], "big"), {"frames": None, "bytes": None, "toc": None}
        i += 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], i = int.from_bytes(data[i : i + 4], "big"), i + 4
        if flags & 4:
            out["toc"] = data[i : i + 100]
        return out
    i = at + 36
    if data[i : i + 4] == b"VBRI" and len(data) >= i + 26:
        size, frames, entries, _, width, _ = struct.unpack(">IIHHHH", data[i + 10 : i + 26])
        return {"frames": frames, "bytes": size, "toc": data[i + 26 : i + 26 + entries * width]}
    return None


def parse(data: bytes) -> dict:
    """tags, vbr (frames, bytes, toc) or None, vbr_ok (whether it agrees with what is there; None without one), offsets,
    lengths, heads (bytes before main data), samples, micros, bad, skipped."""
    at, tags = _tags(data)
    end = len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
    offsets, lengths, heads, vbr, table_bytes = [], [], [], None, 0
    samples: dict[int, int] = {}
    bad, skipped = 0, 0
    checked: dict[bytes, bool] = {}
    known: dict[bytes, Frame | None] = {}
    locked = False
    while at + 4 <= end:
        h = data[at : at + 4]
        if h not in known:
            known[h] = frame_of(int.from_bytes(h, "big"))
        f = known[h]
        n = f.length if f else 0
        if n and not locked:  # resynchronise: what follows must be a frame or the end
            nxt = at + n
            if nxt > end or nxt + 4 <= end and not frame_length(int.from_bytes(data[nxt : nxt + 4], "big")):
                n = 0
        if not n or at + n > end:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            skipped += step - at
            at, locked = step, False
            continue
        locked = True
        protected = not h[1] & 1
        head = 4 + 2 * protected + f.side
        if protected and f.side:
            part = data[at + 2 : at + head]
            ok = checked.get(part)
            if ok is None:
                ok = crc16(part[:2] + part[4:]) == int.from_bytes(part[2:4], "big")
                if len(checked) < 4096:
                    checked[part] = ok
            bad += not ok
        if not offsets and vbr is None and (vbr := _table(data, at, head)) is not None:
            table_bytes = n
        else:
            offsets.append(at)
            lengths.append(n)
            heads.append(head)
            samples[f.rate] = samples.get(f.rate, 0) + f.samples
        at += n
    micros = round(sum((Fraction(1_000_000 * n, rate) for rate, n in samples.items()), Fraction(0)))
    vbr_ok = None if vbr is None else vbr["frames"] in (None, len(offsets)) and vbr["bytes"] in (None, sum(lengths) + table_bytes)
    return {"tags": tags, "vbr": vbr, "vbr_ok": vbr_ok, "offsets": offsets, "lengths": lengths, "heads": heads, "samples": sum(samples.values()), "micros": micros, "bad": bad, "skipped": skipped + max(0, end - at)}


def payload_of(data: bytes, parsed: dict | None = None) -> bytes:
    """The bytes that store() was given, from the frames' main data."""
    x = parsed or parse(data)
    out = b"".join([data[a + h : a + n] for a, n, h in zip(x["offsets"], x["lengths"], x["heads"], strict=True)])
    return out[: int(x["tags"].get("TXXX:payload_bytes", len(out)))]


def feature(x: dict) -> str:
    """Frames, exact duration, checksum failures, bytes skipped, mean bitrate and the seek table's digest."""
    seconds = x["micros"] / 1e6
    seek = hashlib.sha256(np.array(x["offsets"], "<i8").tobytes()).hexdigest()[:16]
    kbps = round(sum(x["lengths"]) * 8 / 1000 / seconds) if seconds else 0
    vbr = x["vbr"] or {}
    agrees = "" if x["vbr_ok"] is None else int(x["vbr_ok"])
    return f"frames={len(x['offsets'])};samples={x['samples']};micros={x['micros']};bad_crc={x['bad']};skipped={x['skipped']};kbps={kbps};vbr_frames={vbr.get('frames', 0)};vbr_bytes={vbr.get('bytes', 0)};vbr_ok={agrees};seek={seek}"


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text, padded with bytes 0 to a positive multiple of 64, as an audio stream."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = string_buffers(b.column(1))
            view, n = raw.tobytes(), np.diff(offsets)
            for i in range(0, len(n), 256):  # few streams at a time in memory
                media = [store(view[a : a + k] + bytes((-k % 64) if k else 64)) for a, k in zip(offsets[i : i + 256].tolist(), n[i : i + 256].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(n[i : i + 256]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def probed(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds what parse() finds in a column of streams: frames, micros, bad_crc, frame_offsets and the digests of the content."""
    keep = [c for c in media.columns if c != column]
    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(column)
            rows = []
            for x in b.column(k):
                data = x.as_py() or b""
                p = parse(data)
                content = payload_of(data, p)
                rows.append((len(content), hashlib.sha256(content).hexdigest(), zlib.crc32(content[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(p), len(p["offsets"]), p["micros"], p["bad"], np.array(p["offsets"], np.int64)))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(x, y) for x, y in zip(cols, kinds, strict=True))], [*keep, *NAMES])

    return media.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, micros long, bad_crc long, frame_offsets array<long>")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "micros", "bad_crc", "frame_offsets"]


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(stored(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "micros", "bad_crc", "frame_offsets")
