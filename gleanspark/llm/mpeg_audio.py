"""Media columns: MPEG audio streams as binary columns.

``parse`` reads any MPEG-1, 2 or 2.5 audio stream (layers I to III). Tags are skipped as units wherever they stand: ID3v2 and ID3v1
(read), APE and Lyrics3 (passed over). It resynchronises on frame headers: a header counts if a frame led to it, if the next header, a
tag, zeros up to the end or the end follows where it says, or if its CRC holds. It reads the counts and seek points of Xing/Info and VBRI
tables and LAME's delays, verifies the CRC of protected frames of every layer and of the LAME tag, and gives exact durations in samples (all of them, and
those left without the encoder's delay and padding) and the byte offset of every frame. LAME's CRC over the music is not verified.

``encode`` stores any bytes losslessly as a variable-bitrate MPEG-1 layer III stream: silent, protected mono frames at
48 kHz carry the bytes as ancillary data behind empty side information. Payload bytes of UTF-8 text never hold
0xFF, so no false sync arises; other payloads are safe too, as frames are chained by length. An ID3v2 tag keeps the payload's
length, a Xing table frame the counts and seek points.

Defined cases: a null text is stored as the empty text; an empty stream or one without frames parses to zero frames and an
empty payload; damaged bytes between frames are skipped and counted as resyncs; frames with a wrong CRC are counted and
kept in the seek table; a stream cut inside its last frame loses that frame; of joined streams the first one's table and tags count, later
table frames are left out of the samples; free-format streams are not read; repeated rows are treated row by row; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import ship

UNIT = 192
#: Fixed values of the standard: kbit/s by (MPEG-1?, layer), and sample rates of MPEG-1.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Frame:
    """What four header bytes say."""

    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    bound: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.version == 1:
            return 17 if self.mono else 32
        return 9 if self.mono else 17

    @property
    def kin(self) -> tuple[float, int, int]:
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(four: bytes) -> Frame | None:
    """The frame that four bytes begin, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    bits, rate, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    hertz = RATES[rate] // (1 if version == 1 else 2 if version == 2 else 4)
    kbits = KBITS[version == 1, min(layer, 3)][bits]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    mode = four[3] >> 6
    bound = ((four[3] >> 4 & 3) + 1) * 4 if mode == 1 else 32
    return Frame(version, layer, not four[1] & 1, kbits, hertz, mode == 3, bound, length, samples)


def _crc_table(reflected: bool) -> list[int]:
    """One step of CRC-16 (polynomial 0x8005) for each byte."""
    table = []
    for crc in range(256):
        crc <<= 0 if reflected else 8
        for _ in range(8):
            crc = (crc >> 1 ^ 0xA001 * (crc & 1)) if reflected else (crc << 1 ^ 0x8005 * (crc >> 15)) & 0xFFFF
        table.append(crc)
    return table


FRAME_CRC, TAG_CRC = _crc_table(False), _crc_table(True)


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of frames: start 0xFFFF, highest bit first, over the first ``bits`` bits (all without)."""
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    crc = 0xFFFF
    for byte in data[:whole]:
        crc = (crc << 8 & 0xFFFF) ^ FRAME_CRC[crc >> 8 ^ byte]
    for bit in range(rest):
        top = crc >> 15 ^ data[whole] >> 7 - bit & 1
        crc = (crc << 1 & 0xFFFF) ^ 0x8005 * top
    return crc


def tag_crc16(data: bytes) -> int:
    """CRC-16 of the LAME tag: start 0, lowest bit first."""
    crc = 0
    for byte in data:
        crc = crc >> 8 ^ TAG_CRC[(crc ^ byte) & 0xFF]
    return crc


def _allocation_bits(frame: Frame) -> list[int]:
    """Bits of a layer II allocation per subband: fixed values of the standard's tables."""
    if frame.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = frame.kbits // (1 if frame.mono else 2)
    if each < 56:
        return [4] * 2 + [3] * (10 if frame.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and frame.rate != 48000 else 4)


def _layer2_bits(body: bytes, frame: Frame) -> int:
    """How many bits of a layer II body its CRC covers: the allocations, and two bits for each that is not zero in each channel."""
    widths = _allocation_bits(frame)
    bound = min(frame.bound, len(widths))
    longest = 2 * sum(widths)
    stream, at, used = int.from_bytes(body[: longest // 8 + 1].ljust(longest // 8 + 1, b"\0"), "big"), 8 * (longest // 8 + 1), 0
    start = at
    for band, width in enumerate(widths):
        separate = not frame.mono and band < bound
        for _ in range(2 if separate else 1):
            at -= width
            used += (stream >> at & (1 << width) - 1 != 0) * (1 if separate or frame.mono else 2)
    return start - at + 2 * used


def crc_holds(data: bytes, at: int, frame: Frame) -> bool:
    """Whether a protected frame's CRC is that of the bits it covers."""
    body = data[at + 6 : at + frame.length]
    if frame.layer == 3:
        bits = 8 * frame.side
    elif frame.layer == 2:
        bits = _layer2_bits(body, frame)
    else:
        bits = 128 if frame.mono else 4 * (32 + frame.bound)
    covered = data[at + 2 : at + 4] + body[: -(-bits // 8)]
    return 8 * len(covered) >= 16 + bits and crc16(covered, 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What a parsed stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    points: list[int] = field(default_factory=list)
    tag_crc_ok: bool | None = None
    offsets: list[int] = field(default_factory=list)
    bitrates: Counter = field(default_factory=Counter)
    rate: int = 0
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    bodies: list[bytes] = field(default_factory=list)

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding."""
        return max(0, self.samples - self.table.get("delay", 0) - self.table.get("padding", 0))

    @property
    def payload(self) -> bytes:
        data = b"".join(self.bodies)
        return data[: int(self.tags["TXXX:payload"])] if self.tags.get("TXXX:payload", "").isdigit() else data


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The tag's length and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = 0
    for byte in data[6:10]:
        size = size << 7 | byte & 0x7F
    end, at, tags, major = min(10 + size, len(data)), 10, {}, data[3]
    while at + 10 <= end and data[at] and major > 2:
        name = data[at : at + 4].decode("latin-1")
        length = 0
        for byte in data[at + 4 : at + 8]:
            length = length << (7 if major == 4 else 8) | byte
        body = data[at + 10 : min(at + 10 + length, end)]
        if name.startswith("T") and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            key, _, value = body[1:].decode(code, "replace").partition("\0")
            tags.update({f"TXXX:{key}": value.rstrip("\0")} if name == "TXXX" else {name: key})
        at += 10 + length
    return end, tags


def _number(data: bytes, at: int, size: int = 4, order: str = "big") -> int:
    return int.from_bytes(data[at : at + size], order)


def _read_table(data: bytes, at: int, frame: Frame, out: Stream) -> bool:
    """Whether the frame at ``at`` is a Xing, Info or VBRI table; out takes the first one's counts, seek points and checks."""
    place, after = at + 4 + 2 * frame.protected + frame.side, at + frame.length
    if frame.layer == 3 and data[place - 2 * frame.protected :][:4] in (b"Xing", b"Info"):
        place -= 2 * frame.protected  # encoders leave no room for a CRC in front of the table
    if frame.layer == 3 and data[place : place + 4] in (b"Xing", b"Info"):
        flags, place, found, marks = _number(data, place + 4), place + 8, {"table": 1}, b""
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and size == 4:
                found[name] = _number(data, place)
            elif flags & bit:
                marks = data[place : min(place + size, after)]
            place += size if flags & bit else 0
        points = [at + mark * found["bytes"] // 256 for mark in marks] if "bytes" in found else []
        good = None
        if data[place : place + 4] == b"LAME" and place + 36 <= after:
            found |= {"delay": _number(data, place + 21, 3) >> 12, "padding": _number(data, place + 21, 3) & 0xFFF}
            good = tag_crc16(data[at : place + 34]) == _number(data, place + 34, 2)
    elif data[at + 36 : at + 40] == b"VBRI":
        found, good = {"table": 2, "bytes": _number(data, at + 46), "frames": _number(data, at + 50)}, None
        entries, scale, size = (_number(data, at + i, 2) for i in (54, 56, 58))
        entries = min(entries, max(0, after - at - 62) // size) if 1 <= size <= 4 else 0
        steps = [scale * _number(data, at + 62 + i * size, size) for i in range(entries)]
        points = list(accumulate(steps[:-1], initial=after)) if steps else []
    else:
        return False
    if not out.table:
        out.table, out.points, out.tag_crc_ok = found, points, good
    return True


def _tag_length(data: bytes, at: int) -> int:
    """The length of the ID3v2 or APE tag that begins at ``at``; 0 if none does."""
    if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 3 : at + 5]) < 0xFF and max(data[at + 6 : at + 10]) < 0x80:
        return 10 + sum(byte << 7 * (3 - i) for i, byte in enumerate(data[at + 6 : at + 10]))
    if data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32:
        return 32 + _number(data, at + 12, 4, "little")
    return 0


def _last_tags(data: bytes, begin: int, out: Stream) -> int:
    """Where the tags at the stream's end begin; out takes the title of ID3v1."""
    end, moved = len(data), True
    while moved:
        before = end
        if data[max(begin, end - 128) : end][:3] == b"TAG" and end - begin >= 128:
            end -= 128
            out.tags.setdefault("TIT2", data[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
        elif data[max(begin, end - 32) : end][:8] == b"APETAGEX":
            head = 32 * (_number(data, end - 12, 4, "little") >> 31)
            end = max(begin, end - max(32, _number(data, end - 20, 4, "little")) - head)
        elif end - begin >= 15 and data[end - 9 : end] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
            end = max(begin, end - 15 - int(data[end - 15 : end - 9]))
        moved = end < before
    return end


def parse(data: bytes) -> Stream:
    """Read a whole stream."""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = _last_tags(data, at, out)
    sound = len(data[:end].rstrip(b"\0"))  # only zeros from here on
    kin, lost, chained, fresh = None, False, False, True
    while at + 4 <= end:
        if length := _tag_length(data, at) if not lost else 0:
            for name, value in _id3v2(data[at : min(at + length, end)])[1].items():
                out.tags.setdefault(name, value)
            at, chained, fresh = at + length, False, True
            continue
        frame = header(data[at : at + 4])
        after = at + frame.length if frame else 0
        counts = frame is not None and after <= end and (kin is None or frame.kin == kin)
        if counts and not chained:
            following = header(data[after : after + 4])
            counts = (
                after == end
                or (following is not None and following.kin == frame.kin)
                or (kin is not None and frame.protected and crc_holds(data, at, frame))
                or _tag_length(data, after) > 0
                or after >= sound
            )
        if not counts:
            if chained and at >= sound:
                break
            out.resyncs += not lost
            lost, chained, at = True, False, data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        if not (fresh and _read_table(data, at, frame, out)):
            out.offsets.append(at)
            out.bitrates[frame.kbits] += 1
            out.samples += frame.samples
            if frame.protected:
                good = crc_holds(data, at, frame)
                out.crc_ok += good
                out.crc_bad += not good
            if frame.layer == 3:
                out.bodies.append(data[at + 4 + 2 * frame.protected + frame.side : after])
        kin, lost, chained, fresh, out.rate, at = frame.kin, False, True, False, frame.rate, after
    return out


SIDE = bytes(17)
CAPACITY = [3 * k - 6 - len(SIDE) for k in KBITS[True, 3]]


@lru_cache(maxsize=32)
def _head(index: int, protected: bool = True) -> bytes:
    """Header, CRC and side information of a silent mono frame at 48 kHz."""
    four = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 3 << 6))
    return four + crc16(four[2:] + SIDE).to_bytes(2, "big") * protected + SIDE


def encode(payload: bytes) -> bytes:
    """payload in a layer III stream: full frames at the highest rate, the last at the lowest that holds the rest."""
    frames, most = [], CAPACITY[-1]
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        index = next(i for i, c in enumerate(CAPACITY) if i and c >= len(part))
        frames.append(_head(index) + part + bytes(CAPACITY[index] - len(part)))
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + bytes(2) + text
    tag = b"ID3\3\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 0x7F)) + tag
    head = _head(5, protected=False)  # 192 bytes: room for the table
    total = 192 + sum(map(len, frames))
    begins, at = [], 192
    for f in frames:
        begins.append(at)
        at += len(f)
    points = bytes(min(255, 256 * begins[i * len(frames) // 100] // total) if frames else 0 for i in range(100))
    table = head + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + points
    return tag + table + bytes(192 - len(table)) + b"".join(frames)


def padded(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of UNIT."""
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


INFO = "frames:long,samples:long,played:long,rate:int,delay:int,padding:int,crc_ok:long,crc_bad:long,resyncs:long,bitrates:string,table_frames:long,points:array<long>,tag_crc_ok:boolean,tags:map<string,string>,offsets:array<long>,payload:binary"


def _per_row(df: DataFrame, column: str, out: str, kind: str, arrow: pa.DataType, f) -> DataFrame:  # noqa: ANN001
    """df with out = f(column), by Arrow batches; an older column of that name is replaced."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    rows = df.select(F.struct(*kept).alias("row"), F.col(column).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * 8_000_000 // max(batch.nbytes, 1))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                made = pa.array([f(v.as_py()) for v in part.column(1)], arrow)
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["row", "made"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, made {kind}")
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("made").alias(out))


def encode_media(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with ``out``: the text's padded UTF-8 bytes as an MPEG stream."""
    return _per_row(docs, text_col, out, "binary", pa.binary(), lambda t: encode(padded((t or "").encode())))


def parse_media(df: DataFrame, media_col: str = "media", out: str = "audio") -> DataFrame:
    """df with ``out``: struct of exact durations, checks, the seek table and the payload read back."""

    def info(data: bytes | None) -> dict:
        s = parse(data or b"")
        return {
            "frames": len(s.offsets), "samples": s.samples, "played": s.played, "rate": s.rate, "delay": s.table.get("delay", 0), "padding": s.table.get("padding", 0), "crc_ok": s.crc_ok, "crc_bad": s.crc_bad, "resyncs": s.resyncs,
            "bitrates": "+".join(f"{n}x{k}" for k, n in sorted(s.bitrates.items())), "table_frames": s.table.get("frames"),
            "points": s.points, "tag_crc_ok": s.tag_crc_ok, "tags": s.tags, "offsets": s.offsets, "payload": s.payload,
        }

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "binary": pa.binary()}
    arrow = pa.struct([(n, kinds[k]) for n, k in re.findall(r"(\w+):([a-z]+(?:<[a-z,]+>)?)", INFO)])
    return _per_row(df, media_col, out, f"struct<{INFO}>", arrow, info)
