"""MPEG audio columns: a parser for MPEG-1, 2 and 2.5, Layers I to III, and a writer of MPEG-1 Layer III streams at variable bit rate.

The payload rides as ancillary bytes of silent frames (side information of zeros,
so the main data is empty and a decoder plays silence).  A stream is an ID3v2 tag,
an information frame with the variable-bit-rate table, the frames, and an ID3v1
tag.  Every frame is protected by the standard's CRC-16; the ID3v2 tag holds the
payload's length and CRC-32.

The parser reads ID3v2.2 to 2.4, ID3v1 and APE tags, Xing, Info and VBRI tables, and
verifies the checksums of Layers I and III (those of Layer II cover a part whose
length is in tables of the sound's coding and are not verified).  Streams of free
format have no frame lengths and are skipped as damage.

Fixed values of the format follow: bit rates, sampling rates, sizes and polynomial.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: kbit/s by (MPEG-1 or not, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second of MPEG-1; 2 has half of them, 2.5 a quarter.
RATES = (44100, 48000, 32000)
SAMPLES = 1152  # in a frame of MPEG-1 Layer III
POLYNOMIAL = 0x8005
RATE, MODE = 1, 3  # 48,000 Hz, one channel
SIDE = 17  # bytes of side information for one channel
HEAD = 4 + 2 + SIDE
UNIT = 192  # the payload is padded to a positive multiple
OWNER = b"payload\0"


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (POLYNOMIAL if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """The frame checksum: over the last two header bytes and what the layer protects."""
    crc = start
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


def length(bitrate: int, rate: int, padding: int = 0) -> int:
    """Bytes of a frame of MPEG-1 Layer III."""
    return 144 * BITRATES[True, 3][bitrate] * 1000 // RATES[rate] + padding


@cache
def head(bitrate: int) -> bytes:
    """Header, checksum and silent side information of a frame."""
    header = bytes((0xFF, 0xFA, bitrate << 4 | RATE << 2, MODE << 6))
    side = bytes(SIDE)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


ROOM = {b: length(b, RATE) - HEAD for b in range(1, 15)}


def pad(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % UNIT or (0 if data else UNIT))


def frames(payload: bytes) -> list[tuple[int, bytes]]:
    """(bit rate, payload part) of each frame: full ones at the highest rate, then the smallest that holds the rest."""
    most = ROOM[14]
    out = [(14, payload[i : i + most]) for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(out) * most :]:
        out.append((next(b for b in range(1, 15) if ROOM[b] >= len(rest)), rest))
    return out


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """A complete stream that holds payload."""
    private = OWNER + len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    frame = b"PRIV" + synchsafe(len(private)) + b"\0\0" + private
    tag = b"ID3\x04\x00\x00" + synchsafe(len(frame)) + frame
    parts = [head(b) + part + bytes(ROOM[b] - len(part)) for b, part in frames(payload)]
    sizes = [len(x) for x in parts]
    info_rate = next(b for b in range(1, 15) if ROOM[b] >= 120)
    info_size, total, at, toc = length(info_rate, RATE), 0, 0, []
    total = info_size + sum(sizes)
    starts = [info_size]
    for n in sizes:
        starts.append(starts[-1] + n)
    for k in range(100):
        at = starts[k * len(sizes) // 100]
        toc.append(min(255, at * 256 // total))
    table = b"Xing" + b"".join(x.to_bytes(4, "big") for x in (7, len(parts), total)) + bytes(toc)
    info = head(info_rate) + table + bytes(ROOM[info_rate] - len(table))
    return tag + info + b"".join(parts) + b"TAG" + bytes(125)


class Frame(NamedTuple):
    """A header: bytes of the frame, samples in it and a second, layer, whether it has a checksum, bytes that the checksum covers behind it, bytes of side information."""

    size: int
    samples: int
    rate: int
    layer: int
    protected: bool
    covered: int
    side: int
    kind: int


@dataclass
class Parsed:
    """What a stream holds.

    offsets: bytes from its start to each audio frame; samples: of all of them; rate: of
    the first; tags: (name, content) of each tag frame; problems: what did not check.
    """

    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    starts: list[float] = field(default_factory=list)
    seconds: float = 0.0
    samples: int = 0
    rate: int = 0
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: bytes = b""
    tags: list[tuple[str, bytes]] = field(default_factory=list)
    skipped: int = 0
    problems: list[str] = field(default_factory=list)


@lru_cache(4096)
def _frame(b1: int, b2: int, b3: int) -> Frame | None:
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    if b1 & 0xE0 != 0xE0 or version == 1 or layer == 4 or not 0 < b2 >> 4 < 15 or b2 >> 2 & 3 == 3:
        return None
    one, mode = version == 3, b3 >> 6
    kbits, rate, padding = BITRATES[one, layer][b2 >> 4], RATES[b2 >> 2 & 3] >> (0 if one else 1 if version == 2 else 2), b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if one or layer == 2 else 576
    size = (12 * kbits * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    side = (17 if mode == 3 else 32) if one else (9 if mode == 3 else 17)
    both = 4 * (1 + (b3 >> 4 & 3)) if mode == 1 else 32 if mode < 3 else 0  # bands of Layer I that two channels have for themselves
    covered = {1: (32 + both) // 2, 2: -1, 3: side}[layer]
    return Frame(size, samples, rate, layer, not b1 & 1, covered, side if layer == 3 else 0, b1 & 0xFE)


def header(data: bytes, at: int) -> Frame | None:
    """The frame whose header stands at this place, or None."""
    return _frame(data[at + 1], data[at + 2], data[at + 3]) if at + 4 <= len(data) and data[at] == 0xFF else None


def checks(data: bytes, at: int, f: Frame) -> bool | None:
    """Whether the frame's checksum is right; None if it has none, or one that is not verified."""
    if not f.protected or f.covered < 0:
        return None
    behind = data[at + 6 : at + 6 + f.covered]
    return len(behind) == f.covered and crc16(bytes(data[at + 2 : at + 4] + behind)) == int.from_bytes(data[at + 4 : at + 6], "big")


def _confirmed(data: bytes, at: int, end: int) -> Frame | None:
    """The frame at this place, if its checksum is right or another of its kind (or the end) follows it."""
    f = header(data, at)
    if not f or at + f.size > end:
        return None
    after = header(data, at + f.size) if at + f.size < end else None
    return f if checks(data, at, f) or at + f.size == end or after and (after.kind, after.rate) == (f.kind, f.rate) else None


def sync(data: bytes, at: int, end: int) -> int:
    """The next place of a frame that something confirms; end if none."""
    while 0 <= (at := data.find(b"\xff", at, end)) < end:
        if _confirmed(data, at, end):
            return at
        at += 1
    return end


def _size(data: bytes, safe: bool) -> int:
    n = 0
    for b in data:
        n = n << 7 | b & 0x7F if safe else n << 8 | b
    return n


def tags(data: bytes) -> tuple[int, int, list[tuple[str, bytes]]]:
    """(first byte behind the tags in front, first byte of those at the end, (name, content) of each tag frame); cut ones end where the data do."""
    at, end, out = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        version, flags = data[at + 3], data[at + 5]
        p, stop = at + 10, at + 10 + _size(data[at + 6 : at + 10], True)
        at = min(len(data), stop + (10 if version == 4 and flags & 0x10 else 0))
        name, whole = (3, 6) if version == 2 else (4, 10)
        if version > 2 and flags & 0x40:
            n = _size(data[p : p + 4], version == 4)
            p += n if version == 4 else n + 4
        while p + whole <= min(stop, len(data)) and data[p]:
            n = _size(data[p + name : p + name + (3 if version == 2 else 4)], version == 4)
            out.append((data[p : p + name].decode("latin-1"), data[p + whole : min(p + whole + n, stop)]))
            p += whole + n
    if end - 128 >= at and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out += [(f"ID3v1 {k}", data[end + a : end + z].rstrip(b"\0 ")) for k, a, z in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)) if data[end + a : end + z].strip(b"\0 ")]
    if end - 32 >= at and data[end - 32 : end - 24] == b"APETAGEX":
        n, count, flags = (int.from_bytes(data[end - 20 + k : end - 16 + k], "little") for k in (0, 4, 8))
        p = end - n
        if at <= p:
            end, stop = p, end - 32
            for _ in range(count):
                z = data.find(b"\0", p + 8, stop)
                if p + 8 > stop or z < 0:
                    break
                n = int.from_bytes(data[p : p + 4], "little")
                out.append((f"APE {data[p + 8 : z].decode('latin-1')}", data[z + 1 : min(z + 1 + n, stop)]))
                p = z + 1 + n
            if flags >> 31 and end - 32 >= at and data[end - 32 : end - 24] == b"APETAGEX":
                end -= 32
    return at, end, out


def _table(data: bytes, at: int, f: Frame, out: Parsed) -> bool:
    """Reads the variable-bit-rate table of an information frame; False if the frame is none.  A cut table gives what it has."""
    x = at + 4 + 2 * f.protected + f.side
    number = lambda p, n=4: int.from_bytes(data[p : min(p + n, at + f.size)], "big")
    if f.layer == 3 and data[x : x + 4] in (b"Xing", b"Info"):
        flags, p = number(x + 4), x + 8
        out.vbr = data[x : x + 4].decode()
        if flags & 1:
            out.vbr_frames, p = number(p), p + 4
        if flags & 2:
            out.vbr_bytes, p = number(p), p + 4
        if flags & 4:
            out.toc = bytes(data[p : min(p + 100, at + f.size)])
        return True
    if data[at + 36 : at + 40] == b"VBRI" and f.size >= 62:
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", number(at + 46), number(at + 50)
        out.toc = bytes(data[at + 62 : min(at + 62 + number(at + 54, 2) * number(at + 58, 2), at + f.size)])
        return True
    return False


def parse(data: bytes) -> Parsed:
    """Reads a stream back.  Damage is skipped by resynchronising; a frame whose checksum fails is reported."""
    at, end, found = tags(data)
    out, body, first = Parsed(tags=found), [], True
    held = next((x[len(OWNER) :] for name, x in found if name == "PRIV" and x.startswith(OWNER)), b"")
    while at < end:
        f = _confirmed(data, at, end)
        if not f:
            nxt = sync(data, at + 1, end)
            out.skipped += nxt - at
            out.problems.append(f"resync at {at}")
            at = nxt
            continue
        if checks(data, at, f) is False:
            out.problems.append(f"checksum at {at}")
        out.rate = out.rate or f.rate
        if not (first and _table(data, at, f, out)):
            out.offsets.append(at)
            out.starts.append(out.seconds)
            out.samples += f.samples
            out.seconds = out.samples / out.rate if f.rate == out.rate else out.seconds + f.samples / f.rate
            body.append(data[at + 4 + 2 * f.protected + f.side : at + f.size])
        first = False
        at += f.size
    out.payload = b"".join(body)
    if held:
        size = int.from_bytes(held[:8], "big")
        out.payload = out.payload[:size]
        if len(held) < 12 or len(out.payload) != size or zlib.crc32(out.payload) != int.from_bytes(held[8:12], "big"):
            out.problems.append("payload checksum")
    if out.vbr_frames and out.vbr_frames != len(out.offsets):
        out.problems.append("frame count")
    return out


def seek(media: Parsed, second: float) -> int | None:
    """The byte from which to play so as to hear this second: exact, by the stored frame offsets; None without frames."""
    from bisect import bisect_right

    return media.offsets[max(0, bisect_right(media.starts, second) - 1)] if media.offsets else None


def level(payload: bytes) -> int:
    """Root mean square of the samples (8 bits, silence at 128) in thousandths."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return math.isqrt(int(x @ x) * 1_000_000 // len(x)) if len(x) else 0


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary, seconds double, offsets array<bigint>, payload binary (read back), level long, problems array<string>.

    A row for each row of docs, repeated ones too; null text is empty, and an empty text
    has a payload of 192 spaces.  An empty table gives no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                rows = [(t or "").encode() for t in b["text"].to_pylist()]
                media = [write(pad(t)) for t in rows]
                read = [parse(m) for m in media]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"], "n_bytes": pa.array(map(len, rows), pa.int64()), "media": pa.array(media, pa.binary()), "seconds": pa.array([x.seconds for x in read], pa.float64()),
                    "offsets": pa.array([x.offsets for x in read], pa.list_(pa.int64())), "payload": pa.array([x.payload for x in read], pa.binary()), "level": pa.array([level(x.payload) for x in read], pa.int64()), "problems": pa.array([x.problems for x in read], pa.list_(pa.string())),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, seconds double, offsets array<bigint>, payload binary, level long, problems array<string>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, problems.

    feature: frames, milliseconds, sampling rate, the first, middle and last frame offset of the stored stream, and the level of the samples read back.
    """
    from pyspark.sql import functions as F

    at = lambda k: F.element_at("offsets", F.greatest(F.lit(1), k)).cast("string")
    n = F.size("offsets")
    feature = F.concat_ws(":", F.lit("mp3"), n.cast("string"), F.round(F.col("seconds") * 1000).cast("bigint").cast("string"), F.lit(str(RATES[RATE])), at(F.lit(1)), at(((n + 1) / 2).cast("int")), at(n), F.col("level").cast("string"))
    return encode(docs).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"), n.cast("bigint").alias("n_frames"), F.size("problems").cast("bigint").alias("n_problems"),
    )
