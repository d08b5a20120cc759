"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets (operator 8).

``parse_mpeg`` walks a stream of MPEG-1/2/2.5 frames of any layer: it skips ID3v2 tags and an ID3v1 tag at which the walk
arrives (the same letters within a frame are data), resynchronises on the next
pair of consistent headers after damage, reads Xing/Info and VBRI tables, verifies the CRC-16 of protected frames and
keeps every frame's offset.  ``wrap_mpeg`` stores bytes losslessly as the main data of layer III frames of two bitrates.
Media are written as a table with their durations and offsets, and all that the query returns is read back from it.

Defined results: a null or empty text is 192 blanks; equal texts give equal media; repeated rows each give a row;
an empty table gives an empty result; other columns are ignored.  Bytes without any frame give zero frames and duration.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, text_or_empty

#: kbit/s by index, and samples/s by index (fixed values of the format).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
UNIT = 192


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    samples: int
    size: int
    side: int


@dataclass
class Stream:
    tags: list[str] = field(default_factory=list)
    vbr: str = ""
    vbr_frames: int = -1
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    skipped: int = 0
    payload: bytes = b""


@lru_cache(4096)
def header_of(word: bytes) -> Header | None:
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3)
    layer, index, rate = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    low = version > 1
    bitrate = BITRATES[2 if low else 1, layer][index]
    hertz = RATES[rate] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    unit = 4 if layer == 1 else 1
    size = (samples // (8 * unit) * bitrate * 1000 // hertz + (word[2] >> 1 & 1)) * unit
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (9 if mono else 17) if low else (17 if mono else 32)
    return Header(version, layer, not word[1] & 1, bitrate, hertz, samples, size, side)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC with polynomial 0x8005 from 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _frame(index: int, data: bytes, info: bytes = b"") -> bytes:
    """A protected stereo frame of MPEG-1 layer III at 48 kHz whose first granule's main data is ``data``."""
    start = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0))
    side = struct.pack(">I", len(data) * 8).ljust(32, b"\0")  # part2_3_length of granule 0, channel 0 ends bit 31
    body = start + struct.pack(">H", crc16(start[2:] + side)) + side + (info or data)
    return body.ljust(header_of(start).size, b"\0")


SMALL, LARGE = 6, 10  # 80 and 160 kbit/s: frames of 240 and 480 bytes


def wrap_mpeg(payload: bytes) -> bytes:
    """Payload of whole 192-byte units as a tagged variable-bitrate stream."""
    frames = [_frame(LARGE, payload[i : i + 2 * UNIT]) if len(payload) - i >= 2 * UNIT else _frame(SMALL, payload[i:]) for i in range(0, len(payload), 2 * UNIT)]
    text = b"\0payload"
    tag = b"TIT2" + struct.pack(">IH", len(text), 0) + text
    size = len(tag)
    head = b"ID3\x03\0\0" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + tag
    total = 240 + sum(map(len, frames))
    ends, at = [240], 240
    for f in frames:
        at += len(f)
        ends.append(at)
    toc = bytes(min(255, ends[len(frames) * p // 100] * 256 // total) for p in range(100))
    first = _frame(SMALL, b"", b"Xing" + struct.pack(">III", 7, len(frames), total) + toc)
    return head + first + b"".join(frames)


def parse_mpeg(data: bytes) -> Stream:
    out, at, end, parts = Stream(), 0, len(data), []
    while data[at : at + 3] == b"ID3" and end - at >= 10:
        size = 0
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b & 0x7F
        out.tags.append(f"id3v2.{data[at + 3]}")
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    synced = False
    while at + 4 <= end:
        if at == tag:
            out.tags.append("id3v1")
            at = end
            break
        h = header_of(data[at : at + 4])
        # a frame that ends within what looks like a tag was cut off by it, unless another frame follows
        cut = h is not None and at < tag < at + h.size < end and header_of(data[at + h.size : at + h.size + 4]) is None
        if h is None or cut or at + h.size > end or not synced and at + h.size + 4 <= end and header_of(data[at + h.size : at + h.size + 4]) is None:
            at, synced = at + 1, False  # resynchronise: the next header must be followed by another, or by the end
            out.skipped += 1
            continue
        synced = True
        body = at + 4
        if h.protected:
            if h.layer == 3 and int.from_bytes(data[body : body + 2]) != crc16(data[at + 2 : body] + data[body + 2 : body + 2 + h.side]):
                out.bad_crc += 1
            body += 2
        table = data[body + h.side : body + h.side + 4] if not out.offsets and not out.vbr else b""
        if table in (b"Xing", b"Info"):
            out.vbr, spot = table.decode(), body + h.side + 8
            flags = int.from_bytes(data[spot - 4 : spot])
            if flags & 1:
                out.vbr_frames, spot = int.from_bytes(data[spot : spot + 4]), spot + 4
            spot += 4 if flags & 2 else 0
            out.toc = data[spot : spot + 100] if flags & 4 else b""
        elif not out.offsets and not out.vbr and data[at + 36 : at + 40] == b"VBRI":
            out.vbr, out.vbr_frames = "VBRI", int.from_bytes(data[at + 50 : at + 54])
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.samples += h.samples
            out.rate = out.rate or h.rate
            if h.layer == 3 and h.side == 32:
                bits = int.from_bytes(data[body : body + 4]) & 0xFFF
                parts.append(data[body + 32 : body + 32 + bits // 8])
        at += h.size
    out.skipped += max(0, end - at)
    out.payload = b"".join(parts)
    return out


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


MEDIA = "n_bytes long, media binary, n_frames long, n_samples long, sample_rate int, duration_s double, offsets array<long>"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id and its text as MPEG audio with exact duration and frame offsets."""

    def store(texts):
        rows = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            media = wrap_mpeg(pad(raw))
            s = parse_mpeg(media)
            rows.append((len(raw), media, len(s.offsets), s.samples, s.rate, s.samples / s.rate if s.rate else 0.0, s.offsets))
        return list(zip(*rows)) or [[]] * 7

    return map_texts(docs.select("doc_id", text_or_empty().alias("text")), lambda: store, MEDIA)


def read_media(table: DataFrame) -> DataFrame:
    """What the stored bytes say: payload digests, media digests and features."""

    def read(media):
        rows = []
        for m in media:
            s = parse_mpeg(m)
            feature = f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};vbr={s.vbr}:{s.vbr_frames};bad_crc={s.bad_crc};skipped={s.skipped};tags={'+'.join(s.tags)};sizes={min(s.sizes, default=0)}-{max(s.sizes, default=0)}"
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, bool(s.bad_crc == 0 and s.skipped == 0)))
        return list(zip(*rows)) or [[]] * 7

    rows = table.select("doc_id", "n_bytes", F.col("media").alias("text"), "duration_s")
    return map_texts(rows, lambda: read, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean")


def documents_as_media(docs: DataFrame) -> DataFrame:
    return read_media(materialize(media_table(docs), "media"))
