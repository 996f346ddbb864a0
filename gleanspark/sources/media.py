"""Sources: frames, images, archives, telemetry and synthetic fields."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_FILES = "*.{jpg,jpeg,png,bmp,gif}"
MEMBER = "archive_id string, ord int, name string, is_dir boolean, unix_mode int, file_size long, compress_size long"
TELEMETRY = "timestamp bigint, data struct<latitude:double,longitude:double,height:double,elevation:double,attitude_head:double,gimbal_pitch:double>"


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures by Spark's image source: path, height, width, data (BGR bytes)."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path)
    return image.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def binaries(spark: SparkSession, path: str, glob: str = "*", most: int = 256_000_000) -> DataFrame:
    """Whole files up to ``most`` bytes; the length filter is applied before content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)


def sampled(frames: DataFrame, source_fps: Column, sample_fps: float = 2.0, most: int = 120, run: str = "run_id", index: str = "idx") -> DataFrame:
    """Every step-th frame, step = max(1, source rate / sample rate rounded half to even), at most ``most`` per run."""
    step = F.greatest(F.lit(1), F.bround(source_fps / sample_fps)).cast("int")
    return frames.where((F.col(index) % step == 0) & (F.floor(F.col(index) / step) < most))


def replicated(stills: DataFrame, most: int | None = None, spacing: float = 0.5) -> DataFrame:
    """A still picture as 3 to 8 frames half a second apart."""
    n = 3 if most is None else min(max(most, 3), 8)
    return stills.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("ts_sec", F.col("frame") * spacing)


def zip_members(files: DataFrame) -> DataFrame:
    """binaryFile rows to one row per archive member; a file that is no archive gives none. Contents are not unpacked."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except zipfile.BadZipFile:
                    continue
                rows += [(path, i, x.filename, x.is_dir(), x.external_attr >> 16, x.file_size, x.compress_size) for i, x in enumerate(infos)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")])

    return files.select("path", "content").mapInPandas(expand, MEMBER)


def read_member(content: bytes, name: str, most: int) -> bytes | None:
    """One member's bytes, or null if it is missing or longer than ``most`` once unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        try:
            with archive.open(name) as member:
                data = member.read(most + 1)
        except KeyError:
            return None
    return data if len(data) <= most else None


def exif_gps(data: bytes) -> dict[str, float] | None:
    """latitude, longitude, altitude of a JPEG's or TIFF's EXIF block; None if both coordinates are missing."""
    at = data.find(b"Exif\0\0")
    block = data[at + 6 :] if at >= 0 else data
    if block[:2] not in (b"II", b"MM"):
        return None
    order = "<" if block[:2] == b"II" else ">"

    def entries(start: int) -> dict[int, tuple[int, int, bytes]]:
        found = {}
        if start + 2 > len(block):
            return found
        for i in range(struct.unpack_from(order + "H", block, start)[0]):
            place = start + 2 + 12 * i
            if place + 12 > len(block):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", block, place)
            found[tag] = (kind, count, block[place + 8 : place + 12])
        return found

    def rationals(entry: tuple[int, int, bytes] | None) -> list[float] | None:
        if entry is None or entry[0] != 5:
            return None
        start = struct.unpack(order + "I", entry[2])[0]
        if start + 8 * entry[1] > len(block):
            return None
        numbers = struct.unpack_from(f"{order}{2 * entry[1]}I", block, start)
        return [a / b if b else 0.0 for a, b in zip(numbers[::2], numbers[1::2], strict=True)]

    head = entries(struct.unpack_from(order + "I", block, 4)[0]) if len(block) >= 8 else {}
    if 0x8825 not in head:
        return None
    gps = entries(struct.unpack(order + "I", head[0x8825][2])[0])
    out: dict[str, float] = {}
    for name, ref, value in (("latitude", 1, 2), ("longitude", 3, 4)):
        parts = rationals(gps.get(value))
        if parts and len(parts) == 3:
            degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
            out[name] = -degrees if gps.get(ref, (0, 0, b""))[2][:1] in (b"S", b"W") else degrees
    height = rationals(gps.get(6))
    if height:
        out["altitude"] = -height[0] if gps.get(5, (0, 0, b"\0"))[2][:1] == b"\1" else height[0]
    return out if "latitude" in out or "longitude" in out else None


def telemetry(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages to readings; what a message lacks is null, the height falls back on the elevation."""
    m = F.from_json(F.col(value).cast("string"), TELEMETRY)
    return raw.select(
        m["timestamp"].alias("timestamp_ms"),
        m["data"]["latitude"].alias("latitude"),
        m["data"]["longitude"].alias("longitude"),
        F.coalesce(m["data"]["height"], m["data"]["elevation"]).alias("altitude_m"),
        m["data"]["attitude_head"].alias("heading_deg"),
        m["data"]["gimbal_pitch"].alias("gimbal_pitch_deg"),
    ).where("timestamp_ms IS NOT NULL")


def pose(readings: DataFrame) -> DataFrame:
    return readings.select((F.col("timestamp_ms") / 1000.0).alias("ts"), "latitude", "longitude", F.col("altitude_m").alias("altitude"), F.col("heading_deg").alias("heading"), F.col("gimbal_pitch_deg").alias("gimbal_pitch"))


def paired(pictures: DataFrame, masks: DataFrame, most: int | None = None) -> DataFrame:
    """Pictures and masks of the same file stem, sorted, those without a mask left out."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    both = pictures.withColumn("stem", stem).join(masks.select(stem.alias("stem"), F.col("data").alias("mask")), "stem")
    return both.orderBy("stem").limit(most) if most is not None else both


def synthetic_field(spark: SparkSession, frames: int = 3, width: int = 64, height: int = 48, seed: int = 7) -> DataFrame:
    """Pixels (frame, y, x, b, g, r, label) of a field: soil, crop rows, a bare patch, a strip of trees; seeded noise."""
    px = spark.range(frames * width * height).select(F.floor(F.col("id") / (width * height)).cast("int").alias("frame"), (F.floor(F.col("id") / width) % height).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    tree, patch = F.col("y") < height // 8, F.col("x").between(width // 3, width // 2) & F.col("y").between(height // 3, height // 2)
    label = F.when(tree, "TREE").when(patch | (F.col("x") % 8 >= 5), "BARE_SOIL").otherwise("CROP")
    colour = lambda t, s, c: F.when(F.col("label") == "TREE", t).when(F.col("label") == "BARE_SOIL", s).otherwise(c)
    noise = lambda i: (F.pmod(F.xxhash64("frame", "y", "x", F.lit(seed + i)), F.lit(13)) - 6).cast("int")
    return px.withColumn("label", label).select("frame", "y", "x", (colour(30, 130, 40) + noise(0)).alias("b"), (colour(80, 140, 160) + noise(1)).alias("g"), (colour(35, 160, 50) + noise(2)).alias("r"), "label")
