"""Reading of whole documents: sections, damage, trees, metadata, outlines, content."""

import random
import zlib

import pytest

from quire.operators import assembly as A
from quire.operators import search as S
from quire.sources import frames as R
from quire.sources.codecs import CodecError, flate
from quire.sources.content import Interpreter, UnicodeMap, glyph_text
from quire.sources.cos import Damage, Name, Reader, Ref
from quire.sources.pdf import CannotOpen, Document, parse_xmp, text_string
from quire.sources.write import text_document


def build(objects: dict[int, bytes], root=1, extra=b"") -> bytes:
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for num, body in sorted(objects.items()):
        places[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    rows = "".join(f"{places[k]:010d} 00000 n \n" if k in places else "0000000000 65535 f \n" for k in range(size))
    return bytes(out) + f"xref\n0 {size}\n{rows}trailer\n<< /Size {size} /Root {root} 0 R ".encode() + extra + f" >>\nstartxref\n{start}\n%%EOF\n".encode()


def stream(body: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(body), more) + body + b"\nendstream"


def test_values():
    read = lambda b, **k: Reader(b, 0, **k).value()
    assert [read(x) for x in (b"00987", b"4.", b"-.002", b"true", b"null")] == [987, 4.0, -0.002, True, None]
    assert isinstance(read(b"9999999999999999999999"), float)
    assert read(b"(a\\(b\\051 (c) \\101\\\n\\r\r\nx)") == b"a(b) (c) A\r\nx" and read(b"<90 1F\nA>") == b"\x90\x1f\xa0"
    assert read(b"<< /A#42 [1 0 R 2 /C] /D << >> >>") == {"AB": [Ref(1, 0), 2, "C"], "D": {}}
    assert type(read(b"/N")) is Name and read(b"[1 0 R]", refs=False)[:2] == [1, 0]
    assert read(b"[" * 511 + b"]" * 511) and read(b"% note\n7") == 7
    for bad in (b"[" * 513 + b"]" * 513, b"(a", b"<<", b"]", b"<9G>", b"", b"[1 endobj"):
        with pytest.raises(Damage):
            read(bad)


@pytest.mark.parametrize("xref", ["table", "stream"])
def test_sections_and_damage(xref):
    lines = [f"line {i} ü漢" for i in range(120)]
    whole = text_document(lines, xref=xref, info={"Title": "Té", "Author": "A"})

    def text(data):
        doc = Document.open(data)
        return [r.text for p in doc.pages() for r in Interpreter(doc).page(p)], doc

    got, doc = text(whole)
    assert got == lines and not doc.warnings.found and len(doc.pages()) == 3
    assert doc.metadata()["title"] == "Té" and doc.metadata()["pdf_version"] == "1.7"
    start = whole.rindex(b"startxref")
    for name, data in {
        "prefix": b"junk\n" + whole,
        "bogus start": whole[:start] + b"startxref\n7\n%%EOF",
        "no start": whole[:start],
        "no end mark": whole[:-7],
        "tail lost": whole[: whole.rindex(b"xref" if xref == "table" else b"/XRef") - 9],
    }.items():
        got, doc = text(data)
        assert got == lines, name
        assert doc.warnings.found, name
    for data, status in ((b"", "notAPDF"), (b"x" * 2000 + whole, "notAPDF"), (b"%PDF-1.4\n", "damaged")):
        with pytest.raises(CannotOpen) as e:
            Document.open(data)
        assert e.value.status == status
    with pytest.raises(CannotOpen) as e:
        Document.open(build({1: b"<< /Type /Catalog >>", 2: b"<< /Filter /Standard >>"}, extra=b"/Encrypt 2 0 R"))
    assert (e.value.status, e.value.detail) == ("encrypted", "Standard")


def test_updates_win_and_cycles_end():
    base = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /MediaBox [0 0 10 10] >>"})
    at = base.rindex(b"xref\n0")
    new = base + b"3 0 obj\n<< /Type /Page /MediaBox [0 0 20 30] /Rotate -90 >>\nendobj\n"
    more = f"xref\n3 1\n{len(base):010d} 00000 n \ntrailer\n<< /Size 4 /Root 1 0 R /Prev {at} >>\nstartxref\n{len(new)}\n%%EOF\n".encode()
    page = Document.open(new + more).pages()[0]
    assert page.media == (0, 0, 20, 30) and page.rotate == 270
    cyclic = base.replace(b"/Root 1 0 R", b"/Root 1 0 R /Prev %d" % at)
    assert len(Document.open(cyclic).pages()) == 1
    loop = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"3 0 R", 3: b"2 0 R"})
    assert Document.open(loop).pages() == []


def test_page_tree():
    doc = Document.open(
        build({
            1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R 3 0 R 7] /MediaBox [10 10 0 0] /Rotate 90 /Count 99 >>",
            3: b"<< /Type /Page >>", 4: b"<< /Kids [5 0 R 6 0 R 2 0 R] /CropBox [2 2 50 50] /Rotate 45 >>", 5: b"<< /Type /Page /Rotate 450 >>", 6: b"<< /Type /Page /MediaBox [0 0 0 5] >>",
        })
    )
    pages = doc.pages()
    assert [p.number for p in pages] == [5, 6, 3]  # of a repeated kid the last place counts
    assert pages[0].crop == (2, 2, 10, 10) and [p.rotate for p in pages] == [90, 0, 90] and pages[2].media == (0, 0, 10, 10)
    assert pages[1].media == (0, 0, 612, 792)


def test_metadata_and_outline():
    xmp = b'<x:xmpmeta xmlns:x="a"><rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:pdf="p"><rdf:Description pdf:Producer="P"><dc:title><rdf:Alt><rdf:li>One</rdf:li><rdf:li>Two</rdf:li></rdf:Alt></dc:title></rdf:Description><broken'
    assert parse_xmp(xmp) == {"producer": "P", "title": "One"}
    doc = Document.open(
        build({
            1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 8 0 R /Version /1.7 /Outlines 10 0 R /Names << /Dests 14 0 R >> /Dests << /old [3 0 R /Fit] >> >>", 2: b"<< /Kids [3 0 R 4 0 R] >>", 3: b"<< /Type /Page >>", 4: b"<< /Type /Page >>",
            7: b"<< /Producer (Mine) /Title 5 >>", 8: stream(xmp), 10: b"<< /First 11 0 R >>", 11: b"<< /Title (A) /Dest [4 0 R /XYZ] /Next 12 0 R /First 13 0 R >>", 12: b"<< /Title <FEFF00E9> /A << /S /GoTo /D (k2) >> /Next 11 0 R >>", 13: b"<< /Dest /old >>",
            14: b"<< /Kids [15 0 R 16 0 R] >>", 15: b"<< /Limits [(a) (b)] /Names [(a) [3 0 R]] >>", 16: b"<< /Limits [(k) (z)] /Names [(k1) [3 0 R] (k2) << /D [1 /Fit] >>] >>",
        }, extra=b"/Info 7 0 R")
    )
    facts = doc.metadata()
    assert (facts["producer"], facts["title"], facts["author"], facts["pdf_version"]) == ("Mine", "One", None, "1.7")
    assert doc.outline() == [(0, "A", 1), (1, "", 0), (0, "é", 1)]
    assert text_string(b"\x80\x84\x7f\xad A") == "•—�� A" and text_string(b"\xfe\xff\0A\0") == "A" and text_string(b"\xef\xbb\xbf\xc3\xa9") == "é"


def test_content_and_fonts():
    font = b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [600 700] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /eacute /uni0416 /comma] >> /FontDescriptor << /MissingWidth 250 /Ascent 900 >> >>"
    body = b"q 2 0 0 2 0 0 cm BT /F 10 Tf 5 Tc 14 TL 10 20 Td (AC) Tj T* [(A) -1000 (D)] TJ 3 Tr (\\200) ' ET Q BI /W 1 ID x\xff\xfe EI /X Do BT /None 8 Tf (z) Tj ET"
    doc = Document.open(
        build({
            1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents [5 0 R 99 0 R 6 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 7 0 R >> >> >>", 4: font,
            5: stream(zlib.compress(body[:40]), b"/Filter /FlateDecode"), 6: stream(body[40:]), 7: stream(b"BT /F 10 Tf (A) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 7 7] /Resources << /Font << /F 4 0 R >> /XObject << /X 7 0 R >> >>"),
        })
    )
    body_parts = doc.contents(doc.pages()[0])
    assert body_parts == body[:40] + b" " + body[40:]
    runs = Interpreter(doc).page(doc.pages()[0])
    assert [r.text for r in runs][-2:] == ["A", "�"]
    first = runs[0]
    assert (first.x, first.y, first.size) == (20, 40, 20) and first.text == "AЖ" and first.advances == pytest.approx([22, 15])
    assert [r.invisible for r in runs if r.text == "€"] == [True]
    assert runs[-2].x == 7 and runs[1].y == 40 - 28 and runs[2].x - runs[1].x == pytest.approx(22 + 20)
    assert glyph_text("uD800") == "�" and glyph_text("a") == "a"
    m = UnicodeMap.parse(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <20> <7E> <0020> <A0> <A2> [<00410042> <0043>] endbfrange")
    assert [m.get(c) for c in (1, 0x41, 0xA0, 0xA1, 0xFFFF)] == ["A", "A", "AB", "C", None]
    with pytest.raises(CodecError):
        bad = Document.open(build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(b"x", b"/Filter /DCTDecode")}))
        Interpreter(bad).page(bad.pages()[0])


def test_tables_and_search(spark):
    rows = [("a", text_document([f"Alpha needle {i}" for i in range(4)], per_page=2)), ("b", b"nothing"), ("c", b""), ("d", None)]
    source = spark.createDataFrame(rows, "doc_id string, content binary")
    status = {r.doc_id: (r.status, r.page_count) for r in R.opened(source).collect()}
    assert status == {"a": ("ok", 2), "b": ("notAPDF", 0), "c": ("notAPDF", 0), "d": ("notAPDF", 0)}
    texts = A.page_texts(R.run_table(source))
    assert {r.page_index: r.text for r in texts.collect()} == {0: "Alpha needle 0\nAlpha needle 1", 1: "Alpha needle 2\nAlpha needle 3"}
    assert S.search(texts, "NEEDLE").count() == 4
    assert R.outline_table(source).count() == 0 and R.page_table(source).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(text_document(["one"]))
    (tmp_path / "y.txt").write_bytes(b"no")
    assert R.opened(R.files(spark, f"file://{tmp_path}")).count() == 1


def test_streams_of_more_than_256_mib_decode():
    size = (256 << 20) + 1
    assert len(flate(zlib.compress(bytes(size), 1))) == size


def test_mutations_end_in_a_result():
    seeds = [text_document(["alpha", "beta"], xref=x, info={"Title": "t"}) for x in ("table", "stream")]
    rng = random.Random(11)
    for _ in range(400):
        data = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(data))
            kind = rng.randrange(4)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                del data[at : at + rng.randint(1, 40)]
            elif kind == 2:
                data[at:at] = data[rng.randrange(len(data)) :][: rng.randint(1, 60)]
            else:
                data[at : at + 4] = b"9999"
        got = R._open(bytes(data))
        if isinstance(got, Document):
            got.metadata(), got.outline()
            for p in got.pages()[:8]:
                try:
                    Interpreter(got).page(p)
                except CodecError:
                    pass


def test_glyph_names_by_rule():
    from quire.sources.content import glyph_text

    names = {"eacute": "é", "Adieresis": "Ä", "ccedilla": "ç", "scaron": "š", "Zdotaccent": "Ż", "ohungarumlaut": "ő", "circumflex": "ˆ", "AE": "Æ", "alpha": "α", "Omega": "Ω", "lambda": "λ", "uni00E9": "é", "what": "�"}
    assert {n: glyph_text(n) for n in names} == names


def test_runs_have_quads(spark):
    from quire.sources.frames import run_table, text_files

    texts = spark.createDataFrame([(1, "first line\nsecond")], "doc_id long, text string")
    runs = run_table(text_files(texts)).collect()
    assert len(runs) == 2
    for r in runs:
        xs, ys = [p.x for p in r.quad], [p.y for p in r.quad]
        assert len(r.quad) == 4 and abs(max(xs) - min(xs) - r.width) < 1e-6 and min(ys) < r.y < max(ys)


def test_a_code_is_looked_up_once_on_a_page(monkeypatch):
    """However long the text is; places and advances are those of adding glyph by glyph."""
    asked, own = [], UnicodeMap.get
    monkeypatch.setattr(UnicodeMap, "get", lambda self, code: asked.append(code) or own(self, code))
    text = "an old canal " * 400
    doc = Document.open(text_document([text, text[5:]]))
    first, second = Interpreter(doc).page(doc.pages()[0])
    assert (first.text, second.text) == (text, text[5:])
    assert len(asked) == len(set(text))
    total = 0.0
    for _ in text:
        total += 500.0 / 1000 * 10.0
    assert first.advances == [5.0] * len(text) and first.quad[1][0] - first.quad[0][0] == total


def test_texts_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from quire.sources.frames import read, run_table, text_files

    pq.write_table(pa.table({"doc_id": range(400), "text": [f"line {k}\nmore" for k in range(400)]}), tmp_path / "t.parquet")
    texts = spark.read.parquet(str(tmp_path / "t.parquet"))
    files = text_files(texts)
    assert files.select(F.spark_partition_id()).distinct().count() > 1
    found = {r.doc_id: (r.status, r.page_count, [tuple(x) for x in r.runs]) for r in read(files).collect()}
    assert found == {k: ("ok", 1, [(0, 0, f"line {k}"), (0, 1, "more")]) for k in range(400)}
    runs = run_table(files, ["page_index", "emit_idx", "text"]).where("doc_id = 7")
    assert sorted(tuple(r) for r in runs.collect()) == [(7, 0, 0, "line 7"), (7, 0, 1, "more")]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from quire.shared import pieces

    texts = ["a" * n for n in (3, 90, 5, 5, 200, 0, 7)] + [None, "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    cut = list(pieces([batch], 100))
    assert [p.column(1).to_pylist() for p in cut] == [texts[:3], texts[3:4], texts[4:5], texts[5:]]
    assert [x for p in cut for x in p.column(0).to_pylist()] == list(range(9))
    assert list(pieces([batch.slice(0, 0)])) == []


def test_page_texts_ask_for_no_more_than_they_need(spark):
    from quire.sources.frames import run_table, text_files

    texts = spark.createDataFrame([(1, "first line\nsecond"), (2, "")], "doc_id long, text string")
    runs = run_table(text_files(texts), A.RUN)
    assert runs.columns == ["doc_id", *A.RUN]
    assert [(r.doc_id, r.page_index, r.text) for r in A.page_texts(runs).collect()] == [(1, 0, "first line\nsecond")]
