"""Metadata of media files from their own bytes: boxes of MP4 and MOV, heads of JPEG, PNG, BMP, GIF, WebP and TIFF pictures.

Files come as Spark's ``binaryFile`` rows and are read in Arrow batches, a few of them at a time; only boxes that say something are walked into, media data is
stepped over. What a file doesn't say is null, and a file that is none of these gives a row with its kind null: one row per file, always.

Defined cases: null or cut off contents give what could be read until there; a box with an impossible size ends its level; of several video tracks the first counts;
sizes are those stored, not turned by the orientation; a rate follows from the track's samples and duration; stills have one frame, rate 1 and duration 0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.geometry import iso6709
from gleanspark.session import ship
from gleanspark.sources.media import exif_gps

FIELDS = [("kind", "string"), ("width", "int"), ("height", "int"), ("fps", "double"), ("frame_count", "long"), ("duration_sec", "double"), ("codec", "string"), ("orientation", "int"), ("created_at", "string"), ("location", "string"), ("latitude", "double"), ("longitude", "double"), ("altitude", "double")]
TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
#: Names of codecs by sample entry.
CODECS = {b"avc1": "h264", b"avc3": "h264", b"hvc1": "hevc", b"hev1": "hevc", b"mp4v": "mpeg4", b"vp09": "vp9", b"av01": "av1", b"jpeg": "mjpeg", b"apcn": "prores", b"apch": "prores"}
EPOCH = datetime(1904, 1, 1, tzinfo=UTC)
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta"}


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, byte behind) of the boxes side by side in data[start:end]."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _times(data: memoryview, at: int) -> tuple[int, int, int]:
    """Creation, time scale and duration of an mvhd or mdhd box."""
    long_form = data[at] == 1
    created, _, scale, duration = struct.unpack_from(">QQIQ" if long_form else ">IIII", data, at + 4)
    return created, scale, duration


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip()


def _tagged(data: memoryview, start: int, end: int) -> dict[str, str]:
    """Texts of a meta box by key."""
    inside: dict[bytes, tuple[int, int]] = {}
    for skip in (0, 4):  # without and with version and flags
        inside = inside if b"keys" in inside else {k: (a, b) for k, a, b in boxes(data, start + skip, end)}
    if b"keys" not in inside or b"ilst" not in inside:
        return {}
    a, b = inside[b"keys"]
    names = [bytes(data[x:y]).decode("utf-8", "replace") for _, x, y in boxes(data, a + 8, b)]
    found = {}
    for kind, x, y in boxes(data, *inside[b"ilst"]):
        number = int.from_bytes(kind, "big")
        for inner, c, d in boxes(data, x, y):
            if inner == b"data" and 1 <= number <= len(names) and d - c >= 8:
                found[names[number - 1]] = _text(bytes(data[c + 8 : d]))
    return found


def _walk(data: memoryview, start: int, end: int, out: dict, track: dict) -> None:
    for kind, a, b in boxes(data, start, end):
        if kind == b"trak":
            own: dict = {}
            _walk(data, a, b, out, own)
            if own.get("handler") == b"vide" and "track" not in out:
                out["track"] = own
        elif kind in HOLDERS:
            _walk(data, a, b, out, track)
        elif kind == b"mvhd":
            out["created"], out["scale"], out["duration"] = _times(data, a)
        elif kind == b"mdhd":
            _, track["scale"], track["duration"] = _times(data, a)
        elif kind == b"tkhd":
            matrix = a + (52 if data[a] == 1 else 40)
            p, q = struct.unpack_from(">ii", data, matrix)
            track["turn"] = {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get(((p > 0) - (p < 0), (q > 0) - (q < 0)))
            track["size"] = tuple(v >> 16 for v in struct.unpack_from(">II", data, matrix + 36))
        elif kind == b"hdlr":
            track["handler"] = bytes(data[a + 8 : a + 12])
        elif kind == b"stsd" and b - a >= 16:
            track["codec"] = bytes(data[a + 12 : a + 16])
        elif kind == b"stts" and b - a >= 8:
            count = min(struct.unpack_from(">I", data, a + 4)[0], (b - a - 8) // 8)
            track["samples"] = sum(struct.unpack_from(">I", data, a + 8 + 8 * i)[0] for i in range(count))
        elif kind == b"meta":
            out.setdefault("tags", {}).update(_tagged(data, a, b))
        elif kind == b"\xa9xyz" and b - a >= 4:
            out["place"] = _text(bytes(data[a + 4 : b]))


def film(data: bytes) -> dict:
    """What the boxes of an MP4 or MOV file say."""
    found: dict = {}
    try:
        _walk(memoryview(data), 0, len(data), found, {})
    except (struct.error, IndexError):  # the last box is cut off
        pass
    track, tags = found.get("track", {}), found.get("tags", {})
    seconds = lambda d: d["duration"] / d["scale"] if d.get("scale") and "duration" in d else None
    own, frames = seconds(track), track.get("samples")
    created = tags.get("com.apple.quicktime.creationdate") or ((EPOCH + timedelta(seconds=found["created"])).strftime("%Y-%m-%dT%H:%M:%S.000000Z") if 0 < found.get("created", 0) < 1 << 35 else None)
    width, height = track.get("size", (None, None))
    codec = track.get("codec")
    return {
        "kind": "video", "width": width, "height": height, "fps": frames / own if frames and own else None, "frame_count": frames, "duration_sec": own if own else seconds(found),
        "codec": CODECS.get(codec, codec.decode("latin-1") if codec else None), "orientation": track.get("turn"), "created_at": created,
        "location": found.get("place") or tags.get("com.apple.quicktime.location.ISO6709"),
    }


def _picture_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a still picture."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", data, 16)
    if data[:2] == b"BM":
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack_from("<HH", data, 6)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack_from("<HH", data, 26)
        return width & 0x3FFF, height & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        start = struct.unpack_from(order + "I", data, 4)[0]
        tags = {}
        for i in range(struct.unpack_from(order + "H", data, start)[0]):
            tag, kind = struct.unpack_from(order + "HH", data, start + 2 + 12 * i)
            tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, start + 10 + 12 * i)[0]
        return (tags[256], tags[257]) if 256 in tags and 257 in tags else None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1 else 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def described(data: bytes | None) -> dict:
    """The fields of one file."""
    if not data:
        return {}
    if data[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
        return film(data)
    try:
        size = _picture_size(data)
    except (struct.error, IndexError):
        return {}
    if size is None:
        return {}
    try:
        place = exif_gps(data) or {}
    except struct.error:
        place = {}
    return {"kind": "image", "width": size[0], "height": size[1], "fps": 1.0, "frame_count": 1, "duration_sec": 0.0, "codec": "image", **place}


def media_metadata(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per file: path and the fields; a film's position is read from its location tag."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # one file's bytes in Python at a time
                told = described(batch.column(1)[at].as_py())
                columns = [batch.column(0).slice(at, 1), *(pa.array([told.get(name)], TYPES[kind]) for name, kind in FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", *(name for name, _ in FIELDS)])

    kind = files.schema[path_col].dataType.simpleString()
    found = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, f"path {kind}, " + ", ".join(f"{n} {t}" for n, t in FIELDS))
    place = found.withColumn("_g", iso6709(F.col("location")))
    return place.withColumns({c: F.coalesce(c, F.col("_g")[c]) for c in ("latitude", "longitude", "altitude")}).drop("_g")
