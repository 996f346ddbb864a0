"""op4: exact round trips, damaged streams, foreign streams."""

import random

import pytest

from gleanspark.llm import mpeg_audio as m


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 936, 937, 938, 100_000])
def test_round_trip(size):
    data = m.padded(bytes(random.Random(size).randrange(256) for _ in range(size)))
    assert len(data) % 192 == 0 and len(data) > 0
    s = m.parse(m.encode(data))
    assert s.payload == data
    assert s.resyncs == s.crc_bad == 0 and s.crc_ok == len(s.offsets) == s.table["frames"]
    assert s.samples == 1152 * len(s.offsets) and s.rate == 48000


def test_resync_and_bad_crc():
    media = bytearray(m.encode(b"x" * 9600))
    clean = m.parse(bytes(media))
    third = clean.offsets[2]
    media[third + 10] ^= 1  # inside the side information
    broken = m.parse(bytes(media))
    assert broken.crc_bad == 1 and broken.offsets == clean.offsets
    noisy = m.parse(bytes(media[:third]) + b"junk\xff\xfbjunk" + bytes(media[third:]) + b"TAG" + b"Song".ljust(125, b"\0"))
    assert noisy.resyncs >= 1 and noisy.tags["TIT2"] == "Song"
    assert len(noisy.offsets) == len(clean.offsets)  # the frame before the junk was led to


def test_foreign_headers():
    # MPEG-2 layer III, 22.05 kHz, 64 kbit/s, stereo, padded: 576 samples, 209 bytes
    f = m.header(bytes((0xFF, 0xF3, 0x82, 0x00)))
    assert (f.version, f.layer, f.rate, f.kbits, f.samples, f.length, f.side) == (2.0, 3, 22050, 64, 576, 209, 17)
    # MPEG-1 layer II, 44.1 kHz, 192 kbit/s: 626 bytes
    assert m.header(bytes((0xFF, 0xFD, 0xA0, 0x00))).length == 626
    # MPEG-1 layer I, 32 kHz, 32 kbit/s: 48 bytes, 384 samples
    f = m.header(bytes((0xFF, 0xFF, 0x18, 0xC0)))
    assert (f.length, f.samples, f.mono) == (48, 384, True)
    assert m.header(b"\xff\xfb\xf0\x00") is None and m.header(b"\xff\xeb\x90\x00") is None and m.header(b"\xff") is None


def test_vbri_and_lame():
    frame = bytearray(m._head(14, False).ljust(960, b"\0"))
    frame[36:54] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big")
    assert m.parse(bytes(frame) * 1 + m._head(14, False).ljust(960, b"\0")).table == {"table": 2, "bytes": 5000, "frames": 7}
    lame = bytearray(m._head(14, False).ljust(960, b"\0"))
    lame[21:33] = b"Info" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big")
    lame[33:37], lame[54:57] = b"LAME", ((576 << 12) | 1000).to_bytes(3, "big")
    assert m.parse(bytes(lame)).table == {"table": 1, "frames": 3, "delay": 576, "padding": 1000}


def test_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 700, "c"), (3, "é" * 700, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, audio string")
    got = m.parse_media(m.encode_media(docs)).collect()
    assert len(got) == 4 and all(r.audio.resyncs == 0 for r in got)
    for r in got:
        assert bytes(r.audio.payload) == m.padded((r.text or "").encode())
    assert got[2] == got[3]
    assert m.parse_media(m.encode_media(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(None,), (b"",), (b"\xff\xfb",)], "media binary")
    assert [r.audio.frames for r in m.parse_media(nothing).collect()] == [0, 0, 0]


def plain_crc(bits, crc, poly=0x8005):
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (poly if crc >> 15 ^ bit else 0)
    return crc


def bits_of(data):
    return [byte >> i & 1 for byte in data for i in range(7, -1, -1)]


def protected_stream(rng, four, side, frames):
    """Frames whose side information (or body) differs, each with its right CRC."""
    length, made = m.header(four).length, []
    for _ in range(frames):
        body = bytes(rng.randrange(255) for _ in range(length - 6))
        covered = bits_of(four[2:]) + side(bits_of(body))
        made.append(four + plain_crc(covered, 0xFFFF).to_bytes(2, "big") + body)
    return made


def test_crcs_of_differing_frames():
    rng = random.Random(5)
    # MPEG-1 layer III at 128 kbit/s, stereo, 44.1 kHz: 32 bytes of side information
    three = protected_stream(rng, bytes((0xFF, 0xFA, 0x90, 0x00)), lambda b: b[:256], 50)
    # layer I, 32 kHz, mono: 32 allocations of four bits
    one = protected_stream(rng, bytes((0xFF, 0xFE, 0x58, 0xC0)), lambda b: b[:128], 50)
    for made in (three, one):
        s = m.parse(b"".join(made))
        assert (len(s.offsets), s.crc_ok, s.crc_bad, s.resyncs) == (50, 50, 0, 0)
        damaged = bytearray(b"".join(made))
        damaged[len(made[0]) + 8] ^= 4
        assert m.parse(bytes(damaged)).crc_bad == 1


@pytest.mark.parametrize(("four", "widths", "bound"), [
    ((0xFF, 0xFC, 0xA0, 0x00), [4] * 11 + [3] * 12 + [2] * 7, 99),  # 192 kbit/s, stereo, 44.1 kHz: 96 each
    ((0xFF, 0xFC, 0xA4, 0x40), [4] * 11 + [3] * 12 + [2] * 4, 4),  # 192 kbit/s, joint stereo from band 4, 48 kHz
    ((0xFF, 0xFC, 0x28, 0xC0), [4] * 2 + [3] * 10, 0),  # 48 kbit/s, mono, 32 kHz
    ((0xFF, 0xF4, 0x80, 0x00), [4] * 4 + [3] * 7 + [2] * 19, 99),  # MPEG-2, stereo
])
def test_layer_two_crc(four, widths, bound):
    mono = four[3] >> 6 == 3

    def covered(bits):
        at = chosen = 0
        for band, width in enumerate(widths):
            for _ in range(2 if not mono and band < bound else 1):
                shared = not mono and band >= bound
                chosen += any(bits[at : at + width]) * (2 if shared else 1)
                at += width
        return bits[: at + 2 * chosen]

    made = protected_stream(random.Random(6), bytes(four), covered, 20)
    s = m.parse(b"".join(made))
    assert (len(s.offsets), s.crc_ok, s.crc_bad) == (20, 20, 0)


def test_seek_points_and_lame_crc():
    media = m.encode(b"x" * 96_000)
    s = m.parse(media)
    begin = s.offsets[0] - 192
    assert len(s.points) == 100 and s.points[0] <= s.offsets[0] and s.points == sorted(s.points)
    assert all(abs(s.points[i] - s.offsets[i * len(s.offsets) // 100]) <= (len(media) - begin) / 256 + 1 for i in range(100))
    vbri = bytearray(m._head(14, False).ljust(960, b"\0"))
    vbri[36:54] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big")
    vbri[54:68] = b"".join(v.to_bytes(2, "big") for v in (3, 2, 2, 4, 480, 960, 1440))
    assert m.parse(bytes(vbri) + m._head(14, False).ljust(960, b"\0")).points == [960, 1920, 3840]
    lame = bytearray(m._head(14, False).ljust(960, b"\0"))
    lame[21:33] = b"Info" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big")
    lame[33:37], lame[54:57] = b"LAME", ((576 << 12) | 1000).to_bytes(3, "big")
    crc = 0
    for byte in lame[:67]:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    lame[67:69] = crc.to_bytes(2, "big")
    audio = m._head(14, False).ljust(960, b"\0")
    s = m.parse(bytes(lame) + 3 * audio)
    assert s.tag_crc_ok is True and s.samples == 3 * 1152 and s.played == 3 * 1152 - 1576
    lame[40] ^= 1
    assert m.parse(bytes(lame) + 3 * audio).tag_crc_ok is False


def test_tags_and_zeros_inside_and_behind():
    a, b = m.encode(b"one " * 2400), m.encode(b"two " * 2400)
    frames = len(m.parse(a).offsets)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32 + 8).to_bytes(4, "little") + bytes(4) + (1 << 31 | 1 << 29).to_bytes(4, "little") + bytes(8)
    ape_end = ape[:20] + (1 << 31).to_bytes(4, "little") + bytes(8)
    joined = m.parse(a + b)
    assert len(joined.offsets) == 2 * frames and joined.resyncs == 0 and joined.table["frames"] == frames
    for tail in (bytes(500), ape + b"x" * 8 + ape_end, b"LYRICSBEGIN" + b"000011LYRICS200", b"TAG".ljust(128, b"\0")):
        s = m.parse(a + tail)
        assert (len(s.offsets), s.resyncs, s.crc_bad) == (frames, 0, 0), tail
    cut = m.parse(a[:-5])
    assert len(cut.offsets) == frames - 1


def test_tags_column(spark):
    song = b"ID3\3\0\0\0\0\0\x10TIT2" + (6).to_bytes(4, "big") + bytes(2) + b"\0Title" + m._head(14, False).ljust(960, b"\0") * 2
    row = m.parse_media(spark.createDataFrame([(song,)], "media binary")).first().audio
    assert row.tags == {"TIT2": "Title"} and row.frames == 2 and row.played == 2304 and row.points == [] and row.tag_crc_ok is None
