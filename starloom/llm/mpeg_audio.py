"""Media columns: MPEG audio.

``encode`` stores bytes without loss in MPEG-1 Layer I frames: 32 kHz, mono, 288 kbit/s, every
subband coded with 8 bits, so that the 12 x 32 samples of a frame are 384 bytes of the payload.  An
ID3v2 tag holds the payload's length and a first, silent frame a VBRI table of seek offsets.
``parse`` reads any MPEG audio: it skips tags and junk, takes a frame header only where the next
one follows or the stream goes on as before, reads Xing and VBRI tables, verifies checksums (layers I and III) and gives exact
durations and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_texts

# MPEG audio tables.
KBITS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]

PAYLOAD, FRAME, BODY = 384, 432, 46
_HEADER = bytes([0xFF, 0xFE, 9 << 4 | 2 << 2, 0xC0])
_BITS = bytes([0x77]) * 16
#: Entries of the seek table at most.
SEEK_ENTRIES = 90


class Header(NamedTuple):
    version: int  # 1; 2 also for version 2.5
    layer: int
    checked: bool
    rate: int
    size: int
    samples: int
    channels: int


def header(h: bytes) -> Header | None:
    """The frame header in four bytes, if it is one (free format is not taken)."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, kbits, rate = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3 or h[3] & 3 == 2:
        return None
    hz, v = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version], 1 if version == 3 else 2
    bits, pad = KBITS[v, layer][kbits] * 1000, h[2] >> 1 & 1
    samples = {1: 384, 2: 1152, 3: 1152 if v == 1 else 576}[layer]
    size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    return Header(v, layer, not h[1] & 1, hz, size, samples, 1 if h[3] >> 6 == 3 else 2)


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _protected(h: Header, mode: int, frame: bytes) -> bytes:
    """The bytes behind the checksum of layer I or III that it covers, with the header's last two before them."""
    if h.layer == 1:
        bound = 4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32
        n = (bound * h.channels + 32 - bound) // 2
    else:
        n = {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[h.version, h.channels]
    return frame[2:4] + frame[6 : 6 + n]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame_head(bits: bytes) -> bytes:
    return _HEADER + crc16(_HEADER[2:] + bits).to_bytes(2, "big") + bits


_HEAD, _SILENT = _frame_head(_BITS), _frame_head(bytes(16))


def encode(payload: bytes) -> bytes:
    """An MPEG file of the payload, which must not hold the byte 0xFF (no sample code; UTF-8 never has it)."""
    if b"\xff" in payload:
        raise ValueError("0xFF is not a sample code")
    note = b"\x03payload_bytes\0%d" % len(payload)
    tag = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    n = -(-len(payload) // PAYLOAD)
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    frames[:, BODY : BODY + PAYLOAD] = np.frombuffer(payload.ljust(n * PAYLOAD, b"\0"), np.uint8).reshape(n, PAYLOAD)
    step = max(1, -(-(n + 1) // SEEK_ENTRIES))
    sizes = [min(step, n + 1 - i) * FRAME for i in range(0, n + 1, step)]
    numbers = [(1, 2), (0, 2), (100, 2), ((n + 1) * FRAME, 4), (n + 1, 4), (len(sizes), 2), (1, 2), (4, 2), (step, 2)]
    table = b"VBRI" + b"".join(x.to_bytes(k, "big") for x, k in numbers) + b"".join(x.to_bytes(4, "big") for x in sizes)
    first = (_SILENT.ljust(36, b"\0") + table).ljust(FRAME, b"\0")
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + first + frames.tobytes()


class Audio(NamedTuple):
    tags: dict[str, str]
    table: dict[str, int | list[int]]
    offsets: list[int]
    samples: int
    rate: int
    checked: int
    wrong: int
    unverified: int
    skipped: int
    payload: bytes

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a fraction: samples and samples a second."""
        return self.samples, self.rate


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    tags, at = {}, 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(data[at + 6 : at + 10]))
        version, p, end = data[at + 3], at + 10, min(len(data), at + 10 + size)
        while version in (3, 4) and p + 10 <= end and data[p]:
            raw = data[p + 4 : p + 8]
            n = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(raw)) if version == 4 else int.from_bytes(raw, "big")
            name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + n)]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value.rstrip("\0")
            p += 10 + n
        at = end
    if len(data) - at >= 128 and data[-128:-125] == b"TAG":
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            tags.setdefault(key, data[a - 128 : b - 128].rstrip(b"\0 ").decode("latin-1"))
    return tags, at


def _table(h: Header, frame: bytes) -> dict[str, int | list[int]]:
    """The variable-bitrate table of a first frame, if it has one."""
    number = lambda a, n: int.from_bytes(frame[a : a + n], "big")
    if frame[36:40] == b"VBRI":
        n, scale, size = number(54, 2), number(56, 2), number(58, 2)
        return {"bytes": number(46, 4), "frames": number(50, 4), "frames_per_entry": number(60, 2), "entries": [number(62 + i * size, size) * scale for i in range(n)]}
    side = {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[h.version, h.channels]
    at = 4 + 2 * h.checked + side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at, table = number(at + 4, 4), at + 8, {}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[key], at = number(at, 4), at + 4
        if flags & 4:
            table["entries"] = list(frame[at : at + 100])
        return table
    return {}


def parse(data: bytes) -> Audio:
    tags, at = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - at >= 128 else len(data)
    offsets, table, parts, good = [], {}, [], {}
    samples = rate = checked = wrong = unverified = skipped = 0
    stream = None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h is not None and (at + h.size + 4 > end or header(data[at + h.size : at + h.size + 4]) is not None)
        if h is None or at + h.size > end or not follows and stream != (h.version, h.layer, h.rate):
            to = data.find(b"\xff", at + 1, end)
            skipped += (end if to < 0 else to) - at
            at = end if to < 0 else to
            continue
        stream = h.version, h.layer, h.rate
        frame_head = data[at : at + 38]
        covered = frame_head[:22] if h.layer == 1 and h.channels == 1 else frame_head  # all that a checksum can depend on
        if h.checked and h.layer == 2:
            unverified += 1
        elif h.checked:
            if (fine := good.get(covered)) is None:
                fine = good[covered] = crc16(_protected(h, data[at + 3], frame_head)) == int.from_bytes(frame_head[4:6], "big")
            checked += 1
            wrong += not fine
        if not offsets and (table := _table(h, data[at : at + h.size])):
            offsets.append(at)
            at += h.size
            continue
        if frame_head[6:22] == _BITS and h.layer == 1 and h.channels == 1 and h.checked:
            parts.append(data[at + BODY : at + BODY + PAYLOAD])
        offsets.append(at)
        samples, rate = samples + h.samples, h.rate
        at += h.size
    payload = b"".join(parts)
    n = tags.get("payload_bytes", "")
    return Audio(tags, table, offsets, samples, rate, checked, wrong, unverified, skipped, payload[: int(n)] if n.isdigit() else payload)


def pad(text: bytes | None) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes."""
    text = text or b""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media of every row; a null text is an empty one, repeated rows stay.

    A text of any length becomes one file.  An empty table gives an empty table.
    """

    def make(batch, texts):
        sizes = pa.array([len(t or b"") for t in texts], pa.int64())
        return {"doc_id": column(batch, "doc_id"), "n_bytes": sizes, "media": pa.array([encode(pad(t)) for t in texts], pa.binary())}

    kind = df.schema[id_col].dataType.simpleString().replace("bigint", "long")
    return map_texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", make, f"doc_id {kind}, n_bytes long, media binary")


def parse_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Read stored MPEG audio: the other columns, and tags, durations, offsets, checksum counts and digests.

    A null or broken file has no frames, no samples and an empty payload.  Of two readings of the
    same bytes the one that starts first counts.  An empty table gives an empty table.
    """
    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, sample_rate int, checked long, wrong long, unverified long, skipped long, seek_offsets array<long>"
    kept = [f for f in df.schema.fields if f.name != media_col]

    def make(batch, files):
        read = [parse(f or b"") for f in files]
        out = {f.name: column(batch, f.name) for f in kept}
        out |= {
            "payload_bytes": [len(a.payload) for a in read],
            "payload_sha256": [hashlib.sha256(a.payload).hexdigest() for a in read],
            "tail_crc32": [zlib.crc32(a.payload[-64:]) for a in read],
            "media_bytes": [len(f or b"") for f in files],
            "media_sha256": [hashlib.sha256(f or b"").hexdigest() for f in files],
            "frames": [len(a.offsets) for a in read],
            "samples": [a.samples for a in read],
            "sample_rate": pa.array([a.rate for a in read], pa.int32()),
            "checked": [a.checked for a in read],
            "wrong": [a.wrong for a in read],
            "unverified": [a.unverified for a in read],
            "skipped": [a.skipped for a in read],
            "seek_offsets": pa.array([a.offsets for a in read], pa.list_(pa.int64())),
        }
        return {k: v if isinstance(v, pa.Array) else pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()}

    before = ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in kept)
    return map_texts(df.select(*[f.name for f in kept], media_col), media_col, make, f"{before}, {new}")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored payload's and file's digests, read back, and a feature string: equal texts, equal values."""
    read = parse_media(encode_media(df, id_col, text_col))
    seek = F.sha2(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")).cast("binary"), 256)
    feature = F.format_string("layer1 %dHz frames=%d samples=%d crc=%d/%d skipped=%d seek=%s", "sample_rate", "frames", "samples", F.col("checked") - F.col("wrong"), "checked", "skipped", F.substring(seek, 1, 16))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
