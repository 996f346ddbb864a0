"""Metadata of files that the tests write byte by byte."""

import struct

from gleanspark.sources import containers


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def film(turn=(0, 65536, -65536, 0), place=b"+40.1234-088.5678+041.200/", handler=b"vide", wide=False, tags=b""):
    times = lambda scale, n: struct.pack(">B3xQQIQ", 1, 3_600_000_000, 0, scale, n) if wide else struct.pack(">4xIIII", 3_600_000_000, 0, scale, n)
    a, b, c, d = turn
    matrix = struct.pack(">9i", a, b, 0, c, d, 0, 0, 0, 1 << 30)
    tkhd = struct.pack(">B3xQQIIQ", 1, 0, 0, 1, 0, 0) if wide else struct.pack(">4xIIIII", 0, 0, 1, 0, 0)
    track = box(b"tkhd", tkhd, bytes(16), matrix, struct.pack(">II", 1280 << 16, 720 << 16))
    stbl = box(b"stbl", box(b"stsd", struct.pack(">4xI", 1), box(b"hvc1", bytes(70))), box(b"stts", struct.pack(">4xIIIII", 2, 200, 1, 100, 1)))
    mdia = box(b"mdia", box(b"mdhd", times(30, 300)), box(b"hdlr", bytes(8), handler, bytes(12)), box(b"minf", stbl))
    udta = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(place), 0x55C4), place)) if place else b""
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(50)) + box(b"moov", box(b"mvhd", times(1000, 10_000), bytes(80)), box(b"trak", track, mdia), udta, tags)


def test_films():
    for wide in (False, True):
        got = containers.described(film(wide=wide))
        assert (got["width"], got["height"], got["fps"], got["frame_count"], got["duration_sec"]) == (1280, 720, 30.0, 300, 10.0)
        assert (got["codec"], got["orientation"], got["created_at"], got["location"]) == ("hevc", 90, "2018-01-28T16:00:00.000000Z", "+40.1234-088.5678+041.200/")
    assert containers.described(film(turn=(-65536, 0, 0, -65536)))["orientation"] == 180
    sound = containers.described(film(handler=b"soun"))
    assert sound["width"] is None and sound["duration_sec"] == 10.0
    keys = box(b"keys", struct.pack(">4xI", 2), box(b"mdta", b"com.apple.quicktime.creationdate"), box(b"mdta", b"com.apple.quicktime.location.ISO6709"))
    values = box(b"ilst", *(box(struct.pack(">I", i), box(b"data", struct.pack(">II", 1, 0), v)) for i, v in ((1, b"2024-05-01T10:00:00+0200"), (2, b"-12+007.5/"))))
    for head in (b"", bytes(4)):
        got = containers.described(film(place=b"", tags=box(b"meta", head, keys, values)))
        assert (got["created_at"], got["location"]) == ("2024-05-01T10:00:00+0200", "-12+007.5/")


def test_cut_off_and_foreign():
    whole = film()
    for n in range(0, len(whole), 7):
        containers.described(whole[:n])
    assert containers.described(b"no medium at all") == {} == containers.described(b"") == containers.described(None)
    assert containers.described(struct.pack(">I4s", 5, b"ftyp"))["width"] is None


def test_pictures():
    size = lambda data: (lambda d: (d.get("width"), d.get("height")))(containers.described(data))
    assert size(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 17) + bytes(9)) == (31, 17)
    assert size(b"BM" + bytes(16) + struct.pack("<ii", 31, -17)) == (31, 17)
    assert size(b"GIF89a" + struct.pack("<HH", 31, 17)) == (31, 17)
    assert size(b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (30).to_bytes(3, "little") + (16).to_bytes(3, "little")) == (31, 17)
    assert size(b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (30 | 16 << 14).to_bytes(4, "little")) == (31, 17)
    assert size(b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + struct.pack("<HH", 31, 17)) == (31, 17)
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        tags = struct.pack(order + "HHHIHxxHHII", 2, 256, 3, 1, 31, 257, 4, 1, 17)
        assert size(mark + struct.pack(order + "I", 8) + tags) == (31, 17)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 17, 31) + bytes(10)
    assert size(jpeg) == (31, 17)
    assert size(jpeg[:22]) == (None, None)


def test_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(film())
    (tmp_path / "b.mp4").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5:]: r for r in containers.media_metadata(files).collect()}
    assert len(got) == 2 and got["b.mp4"].kind is None
    assert (got["a.mp4"].latitude, got["a.mp4"].longitude, got["a.mp4"].altitude) == (40.1234, -88.5678, 41.2)
    assert containers.media_metadata(files.limit(0)).count() == 0
