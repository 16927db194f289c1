import hashlib
import random
import struct
import zlib

from quire.llm.media import crc16, describe, header, media_digests, parse, parse_media, payload, store_media, write


def test_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 20_000):
        for data in (rng.randbytes(n), b"\xff" * n, (b"\xff\xfa\xc4\x00" * n)[:n]):
            b = write(data)
            info = parse(b)
            assert payload(b, info) == data.ljust(max(1, -(-n // 576)) * 576, b"\xff")
            assert info.table_frames == len(info.offsets) == max(1, -(-n // 576)) and info.crc_bad == 0 == info.skipped
            assert info.samples == 1152 * len(info.offsets) and info.first.rate == 48000 and info.tags["payload_bytes"] == str(n)


def test_damage():
    data = random.Random(2).randbytes(576 * 20)
    b = bytearray(write(data))
    start = parse(bytes(b)).offsets
    b[start[3] : start[3] + 2] = b"\0\0"  # a lost header: found again at the next frame
    info = parse(bytes(b))
    assert info.resyncs == 1 and info.skipped == 672 and len(info.offsets) == 19
    b[start[5] + 10] ^= 1  # side information
    assert parse(bytes(b)).crc_bad == 1
    assert len(parse(b"junk" * 9 + bytes(b[:-700]) + b"TAG" + bytes(125)).offsets) == 17
    for junk in (b"", b"\xff", b"\xff\xfb\x90\x00", b"ID3", b"ID3\3\0\0\0\0\0\5xx", b"\xff" * 5000):
        parse(junk)


def test_headers_and_tables():
    h = header(bytes([0xFF, 0xFB, 0x92, 0xC0]))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, padded, mono
    assert (h.length, h.samples, h.side, h.mono, h.protected) == (418, 1152, 17, True, False)
    h = header(bytes([0xFF, 0xF3, 0x80, 0x00]))  # MPEG-2 Layer III, 64 kbit/s, 22.05 kHz
    assert (h.version, h.length, h.samples) == (2, 208, 576)
    assert header(bytes([0xFF, 0xFF, 0x10, 0x00])).length == 32 * 12000 // 44100 * 4
    assert header(b"\xff\xfb\xf0\0") is header(b"\xff\xeb\x90\0") is header(b"abcd") is None
    f = bytearray(417)
    f[:4] = b"\xff\xfb\x90\0"
    v = bytearray(f)
    v[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4170, 9, 2, 1, 2, 5)
    v[62:66] = struct.pack(">HH", 2085, 2085)
    p = parse(bytes(v) + bytes(f) * 9)
    assert (p.table, p.table_frames, p.table_bytes, p.seek_points, len(p.offsets)) == ("VBRI", 9, 4170, [0, 2085, 4170], 9)


def test_crc_against_bitwise():
    import numpy as np

    for data in (b"\0", b"123456789", bytes(range(34))):
        crc = 0xFFFF
        for byte in data:
            for k in range(7, -1, -1):
                top = (crc >> 15) ^ (byte >> k & 1)
                crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        assert int(crc16(np.frombuffer(data, np.uint8)[None])[0]) == crc


def test_columns(spark):
    rows = [(1, "abc", b"x"), (1, "abc", None), (None, None, None), (2, "", None), (3, "é" * 1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    stored = store_media(docs)
    out = media_digests(stored).collect()
    assert len(out) == 5
    for r in out:
        text = {1: b"abc", 3: "é".encode() * 1000}.get(r.doc_id, b"")
        padded = text.ljust(max(1, -(-len(text) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:]) and r.media_sha256 == hashlib.sha256(write(text)).hexdigest()
    info = {r.doc_id: r.info for r in parse_media(stored).collect()}
    assert info[3].n_frames == len(info[3].frame_offsets) == 4 and info[3].duration_s == 4 * 1152 / 48000
    assert parse_media(docs).where("doc_id is null").first().info.n_frames == 0
    assert media_digests(stored.limit(0)).count() == 0 and describe(b"")[0]["n_frames"] == 0


def test_nothing_fails_on_short_frames_and_foreign_bytes(spark):
    import random

    from quire.llm.media import media_digests, parse, write

    rng = random.Random(9)
    heads = [bytes([0xFF, a, b, c]) for a in (0xF2, 0xF3, 0xFA, 0xFB, 0xE3, 0xFD, 0xFF) for b in (0x10, 0x14, 0x18, 0xC4, 0x92) for c in (0x00, 0xC0)]
    for head in heads:
        for mark in (b"Xing", b"Info", b"VBRI"):
            for size in (4, 9, 12, 17, 20, 24, 36, 40, 60, 120):
                body = bytearray(rng.randbytes(size))
                place = rng.choice([0, 5, 9, 11, 13, 17, 32, 34])
                body[place : place + 4] = mark
                parse((head + bytes(body)) * rng.choice([1, 2, 3]))
    good = write(b"some text")
    broken = bytearray(good)
    broken[-100] ^= 1  # within the payload
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"foreign")), (4, broken), (5, bytearray(good[:300])), (6, bytearray())]
    got = {r.doc_id: r for r in media_digests(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].n_bytes == 9 and got[1].payload_bytes == 576
    assert all(got[k].payload_sha256 is None and got[k].feature is None for k in range(2, 7))
