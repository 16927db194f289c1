"""Golden values of the column functions and codecs."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import assembly as A
from quire.operators import layout as Y
from quire.operators import marks as M
from quire.operators import search as S
from quire.operators import selection as L
from quire.operators import structure as D
from quire.sources import codecs as C


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_matches():
    assert T.find_matches("hello world", "world") == [(6, 11)]
    assert T.find_matches("aaa", "aa") == [(0, 2)]
    assert T.find_matches("café", "cafe") == [(0, 4)] and T.find_matches("café", "cafe") == [(0, 5)]
    assert T.find_matches("café", "cafe", diacritic_sensitive=True) == []
    assert T.find_matches("🙂x", "x") == [(2, 3)]
    assert len(T.find_matches("a" * 1050, "a", limit=1000)) == 1000
    text, lo, hi = T.snippet("🙂" * 39 + "Xneedle\nmore", 79, 85, 40)
    assert "\n" not in text and text.encode("utf-16-le")[2 * lo : 2 * hi].decode("utf-16-le") == "needle"


def test_search_rules(spark):
    pages = spark.createDataFrame([(1, p, "alpha needle\nNEEDLE " * 3) for p in range(8)] + [(1, 9, None), (2, 0, "néedle")], "doc_id int, page_index int, text string")
    found = S.search(pages, " needle ").collect()
    assert len(found) == 49 and S.search(pages, "  ").count() == 0
    assert S.search(pages, "needle", per_page=2, per_document=5).where("doc_id = 1").count() == 5
    assert S.search(pages, "needle", S.Options(case_sensitive=True)).where("doc_id = 1").count() == 24
    assert one(spark, S.advance(F.lit(4), 1, F.lit(5)), S.advance(F.lit(0), -1, F.lit(5)), S.advance(F.lit(0), 1, F.lit(0))) == (0, 4, None)


@pytest.mark.parametrize("text, at, want", [("hello world", 2, (0, 5)), ("hello world", 0, (0, 5)), ("hello world", 11, (6, 11)), ("hi  there", 3, (4, 9)), ("hello, world", 1, (0, 5)), ("..", 0, None)])
def test_words(spark, text, at, want):
    w = one(spark, T.word_at(F.lit(text), F.lit(at)))[0]
    assert (w and tuple(w)) == want


def test_geometry(spark):
    r = G.rect(F.lit(10), F.lit(20), F.lit(-4), F.lit(6))
    assert tuple(one(spark, G.bounds(G.quad_of(r)))[0]) == (6, 20, 4, 6)
    assert one(spark, *(G.rotation(F.lit(v)) for v in (-90, 450, 45, None))) == (270, 90, 0, 0)
    crop = G.rect(F.lit(5), F.lit(7), F.lit(100), F.lit(200))
    for turn in (0, 90, 180, 270):
        there = G.display_map(crop, F.lit(turn))
        back = G.moved(G.moved(G.point(F.lit(11), F.lit(13)), there), G.inverse(there))
        assert all(math.isclose(a, b) for a, b in zip(one(spark, back)[0], (11, 13), strict=True))
    inside = lambda x, y, q=crop: G.inside(G.point(F.lit(x), F.lit(y)), G.quad_of(q))
    flat = G.rect(F.lit(1), F.lit(1), F.lit(0), F.lit(0))
    assert one(spark, inside(5, 7), inside(50, 50), inside(4.9, 50), inside(1, 1, flat), inside(float("nan"), 50)) == (True, True, False, False, False)
    quad = G.quad_of(G.rect(F.lit(0), F.lit(0), F.lit(100), F.lit(10)))
    part = G.part_of_quad(quad, F.array(*(F.lit(10.0) for _ in range(10))), F.lit(2), F.lit(5))
    assert tuple(one(spark, G.bounds(part))[0]) == (20, 0, 30, 10)
    assert one(spark, G.normal_rect(*map(F.lit, (1.0, 2.0, 1.0, 5.0))), M.clamped(F.lit(1.5)), M.clamped(F.lit(float("nan")))) == (None, 1.0, 0.0)


def test_scale_buckets(spark):
    values = (1.0, math.sqrt(2) + 0.001, 0.7, 1e9, 1e-9, 0.0, -5.0, float("nan"), float("inf"))
    assert one(spark, *(Y.scale_bucket(F.lit(v)) for v in values)) == (0, 1, -1, 12, -8, 0, 0, 0, 0)


def test_dates(spark):
    cases = {
        "D:20240321094500+09'00'": "2024-03-21 00:45:00", "D:20240321094500+0900": "2024-03-21 00:45:00", "D:2024": "2024-01-01 00:00:00",
        "20240101120000Z": "2024-01-01 12:00:00", "D:20241301": "2024-01-01 00:00:00", "D:20240101120165": "2024-01-01 12:01:00", "D:19": None, "": None, "garbage": None,
        "D:20240230": "2024-03-01 00:00:00",
    }
    frame = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert frame.where(~D.parsed_date(F.col("t")).cast("string").eqNullSafe(F.col("want"))).count() == 0


def test_reading_order(spark):
    def text(runs):
        rows = [(1, 0, i, t, float(x), float(y), 1.0, 0.0, float(s), 8.0 * len(t), False) for i, (t, x, y, s) in enumerate(runs)]
        frame = spark.createDataFrame(rows, "doc_id int, page_index int, emit_idx int, text string, x double, y double, dx double, dy double, size double, width double, vertical boolean")
        return A.page_texts(frame).first().text, A.page_texts(frame, columns=True).first().text

    assert text([("AB", 0, 0, 12), ("CD", 100, 0, 12)])[0] == "AB CD"
    assert text([("AB", 0, 0, 12), ("CD", 16, 0, 12)])[0] == "ABCD"
    assert text([("Bottom", 0, 650, 12), ("Top", 0, 700, 12)])[0] == "Top\nBottom"
    two = [(f"L{i}" + "x" * 12, 50, 700 - 20 * i, 12) for i in range(3)] + [(f"R{i}" + "x" * 12, 200, 700 - 20 * i, 12) for i in range(3)]
    assert text(two)[1].replace("x", "") == "L0\nL1\nL2\nR0\nR1\nR2"
    wide = [("Title" + "x" * 27, 50, 720, 12), *two]
    assert text(wide)[1].replace("x", "") == "Title\nL0\nL1\nL2\nR0\nR1\nR2"


def test_narrow_columns_merge():
    assert A.merge_narrow([10.0, 50.0], [(0, 9), (11, 49), (51, 100)], 20.0) == [50.0]
    assert A.merge_narrow([45.0, 55.0], [(0, 44), (46, 54), (56, 100)], 20.0) == [55.0]  # as near to both: left
    assert A.merge_narrow([45.0, 55.0], [(0, 44), (46, 54), (56, 80)], 20.0) == [45.0]
    assert A.merge_narrow([50.0], [(0, 45), (55, 100), (10, 90)], 20.0) == [50.0]  # one that crosses doesn't count
    assert A.merge_narrow([30.0, 60.0], [(0, 29), (61, 100)], 20.0) == [60.0]  # a column without segments has no width
    assert A.merge_narrow([10.0, 20.0, 60.0], [(0, 9), (11, 19), (21, 59), (61, 100)], 25.0) == [60.0]  # the first first


def test_selection_diff(spark):
    got = one(spark, L.changed_pages(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3, 4))), F.array(F.lit(3))))[0]
    assert got == [1, 3, 4]


def test_glyphs_and_versions(spark):
    names = [("uni0041", "A"), ("u1F642", "🙂"), ("x", "x"), ("uniD800", None), ("space", " "), ("what", None)]
    assert [one(spark, D.glyph_unicode(F.lit(n), {"space": " "}))[0] for n, _ in names] == [v for _, v in names]
    assert one(spark, D.greatest_version(F.lit("1.9"), F.lit("1.10")), D.greatest_version(F.lit("x"), F.lit("1.4"))) == ("1.10", "1.4")


def test_hex_and_85():
    assert C.ascii_hex(b"901FA3>") == b"\x90\x1f\xa3" and C.ascii_hex(b"901FA>") == b"\x90\x1f\xa0" and C.ascii_hex(b"90 1F\nA3") == b"\x90\x1f\xa3"
    assert C.ascii85(b"!!!!!") == bytes(4) and C.ascii85(b'!!!!"') == b"\0\0\0\1" and C.ascii85(b"zz") == bytes(8) and C.ascii85(b"<~z~>") == bytes(4)
    for f, data, code in [(C.ascii_hex, b"9G>", "invalidCharacter"), (C.ascii85, b"!z", "invalidCharacter"), (C.ascii85, b"!!!!!!", "truncated"), (C.ascii85, b"uuuuu", "corrupted"), (C.run_length, b"\x02ab", "truncated"), (C.flate, zlib.compress(b"x" * 99)[:-9], "truncated"), (C.flate, b"\xff\xff\xff", "corrupted")]:
        with pytest.raises(C.CodecError) as e:
            f(data)
        assert e.value.code == code
    with pytest.raises(C.CodecError):
        C.flate(zlib.compress(bytes(10_000)), cap=100)


def test_run_length_and_predictors():
    assert C.run_length(bytes.fromhex("0201020380")) == b"\1\2\3" and C.run_length(bytes.fromhex("FCAA80")) == b"\xaa" * 5 and C.run_length(b"\x80") == b""
    assert C.predictor(bytes([10] * 4), {"Predictor": 2, "Columns": 4}) == bytes([10, 20, 30, 40])
    assert C.predictor(bytes.fromhex("01000200"), {"Predictor": 2, "Columns": 2, "BitsPerComponent": 16}) == bytes.fromhex("01000300")
    rng = random.Random(1)
    for n in (0, 1, 7, 500):
        data = rng.randbytes(n)
        assert C.predictor(C.png_encode(data, 7), {"Predictor": 12, "Columns": 7})[:n] == data


def test_lzw_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 2, 300, 20_000):
        for data in (rng.randbytes(n), b"ab" * n, bytes(rng.choice(b"abc") for _ in range(n))):
            for early in (0, 1):
                assert C.lzw(C.lzw_encode(data, early), early) == data


def test_damaged_lzw_ends_as_a_plain_walk_does():
    def plain(data, early):
        table, out, width, last, bits, held = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9, None, 0, 0
        for byte in data:
            held, bits = held << 8 | byte, bits + 8
            if bits < width:
                continue
            bits -= width
            code, held = held >> bits, held & (1 << bits) - 1
            if code == 256:
                del table[258:]
                width, last = 9, None
                continue
            if code == 257:
                break
            if code > len(table) or code == len(table) and (last is None or code == 4096):
                return "corrupted"
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            while width < 12 and len(table) + early >= 1 << width:
                width += 1
        return out

    def decoded(data, early):
        try:
            return C.lzw(data, early)
        except C.CodecError as e:
            return e.code

    rng = random.Random(9)
    for k in range(200):
        early = k % 2
        data = bytearray(C.lzw_encode(bytes(rng.choices(range(rng.choice((1, 2, 4, 256))), k=rng.choice((0, 1, 40, 9000)))), early))
        for _ in range(k % 3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(0, len(data))] if k % 5 == 0 else data)
        assert decoded(data, early) == plain(data, early)


def test_round_trips_of_one_row_group_are_many_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quire.plans.queries import QUERIES

    pq.write_table(pa.table({"doc_id": range(400), "text": [f"line {k}" for k in range(400)]}), tmp_path / "documents.parquet")
    for name in ("lzw_roundtrip", "cid_segments"):
        assert QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1
