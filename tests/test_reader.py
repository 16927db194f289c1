"""Pointers on runs, caches, embedded glyph maps and limits of documents against plain versions."""

import random

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import caches, layout, marks, pointer, selection
from quire.sources import content, pdf
from quire.sources.write import text_document

RUNS = "doc_id int, page_index int, run_lo int, run_hi int, quad array<struct<x:double,y:double>>, advances array<double>"


def pages_of_runs(rng):
    """Pages of lines of runs at random places, some turned, with astral letters in the text."""
    texts, runs = [], []
    for page in range(6):
        text, lines = "", []
        for _ in range(rng.randint(1, 14)):
            line, parts = "", []
            for _ in range(rng.randint(1, 3)):
                word = "".join(rng.choice(["a", "b", " ", "\U0001d400", "!"]) for _ in range(rng.choice([1, 2, 4, 8])))
                lo = len((text + line).encode("utf-16-le")) // 2
                parts.append((lo, lo + len(word.encode("utf-16-le")) // 2))
                line += word + rng.choice(["", " "])
            text += line + rng.choice(["\n", "\r", "\u2028"])
            lines.append(parts)
        texts.append((1, page, text))
        for k, parts in enumerate(lines):
            x, y = rng.choice([0.0, 16.0]), rng.choice([k * 16.0, rng.randint(0, 100) * 2.0])
            turned = rng.random() < 0.2
            for lo, hi in parts:
                wide = (hi - lo) * 4.0
                dx, dy = (0.0, wide) if turned else (wide, 0.0)
                quad = [(x, y), (x + dx, y + dy), (x + dx, y + dy - 8), (x, y - 8)]
                advances = [1.0] * (hi - lo) if rng.random() < 0.8 else [0.0] * (hi - lo)
                runs.append((1, page, lo, hi, quad, advances))
                x, y = (x, y + dy + 4) if turned else (x + dx + rng.choice([0.0, 4.0]), y)
    return texts, runs


def plain_offset(px, py, runs, text):
    """Lines by breaks in the gaps between runs, then the nearest line, run and character end, one by one."""
    raw = text.encode("utf-16-le")
    lines = []
    for r in sorted(runs, key=lambda r: r[2:4]):
        gap = raw[lines[-1][-1][3] * 2 : r[2] * 2].decode("utf-16-le") if lines else ""
        if not lines or any(c in "\n\r\u2028\u2029" for c in gap):
            lines.append([])
        lines[-1].append(r)
    found = []
    for k, line in enumerate(lines):
        (ax, ay), (bx, by) = line[0][4][:2]
        long = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        axis = ((bx - ax) / long, (by - ay) / long) if long >= 0.25 else (1.0, 0.0)
        along = lambda p, axis=axis: p[0] * axis[0] + p[1] * axis[1]
        ys = [y for r in line for _, y in r[4]]
        spans = [sorted((along(r[4][0]), along(r[4][1]))) for r in line]
        found.append((k, line, along, min(ys), max(ys), spans, min(s for s, _ in spans), max(e for _, e in spans)))
    order = sorted(found, key=lambda f: ((f[3] + f[4]) / 2, f[0]))
    low = sum((f[3] + f[4]) / 2 < py for f in order)
    near = order[max(0, low - 4) : low + 4]
    k, line, along, _, _, spans, p0, p1 = min(near, key=lambda f: (max(0, f[3] - py, py - f[4]) + max(0, f[6] - f[2]((px, py)), f[2]((px, py)) - f[7]), f[0]))
    p = along((px, py))
    if p <= p0 or p >= p1:
        return k, line[0][2] if p <= p0 else line[-1][3]
    far = [max(0, s - p, p - e) for s, e in spans]
    i = max(j for j, d in enumerate(far) if d == min(far))
    (s, e), r = spans[i], line[i]
    if far[i]:
        return k, r[2] if p < s else r[3]
    total = sum(r[5])
    if not total:
        return k, r[2]
    ends = [sum(r[5][:j]) for j in range(len(r[5]) + 1)]
    off = [abs(v - (p - s) / (e - s) * total) for v in ends]
    return k, r[2] + max(j for j, d in enumerate(off) if d == min(off))


def test_points_on_runs(spark):
    rng = random.Random(8)
    texts, runs = pages_of_runs(rng)
    points = [(1, rng.randint(0, 5), k, rng.randint(-10, 150) * 1.0, rng.randint(-20, 220) * 1.0) for k in range(600)]
    frame, pages = spark.createDataFrame(runs, RUNS), spark.createDataFrame(texts, "doc_id int, page_index int, text string")
    lines = pointer.selection_lines(pointer.numbered_runs(frame, pages))
    got = {r.id: (r.line_no, r.offset) for r in pointer.text_offsets(spark.createDataFrame(points, "doc_id int, page_index int, id int, x double, y double"), lines).collect()}
    text = {p: t for _, p, t in texts}
    want = {k: plain_offset(x, y, [r for r in runs if r[1] == page], text[page]) for _, page, k, x, y in points}
    assert got == want


def test_quads_of_turned_lines_stay_apart(spark):
    frame = spark.createDataFrame([(1, 0, 0, 2, [(0.0, 0.0), (8.0, 0.0), (8.0, -8.0), (0.0, -8.0)], [1.0, 1.0]), (1, 0, 2, 4, [(8.0, 0.0), (16.0, 1.0), (16.0, -7.0), (8.0, -8.0)], [1.0, 1.0])], RUNS)
    pages = spark.createDataFrame([(1, 0, "abcd")], "doc_id int, page_index int, text string")
    numbered = pointer.numbered_runs(frame, pages)
    ranges = spark.createDataFrame([(1, 0, 5, 0, 2), (1, 0, 6, 1, 3), (1, 0, 7, 4, 9)], "doc_id int, page_index int, id int, lo int, hi int")
    assert {r.id: len(r.quads) for r in pointer.display_quads(ranges, numbered).collect()} == {5: 1, 6: 2}
    flat = spark.createDataFrame([(1, 0)], "doc_id int, page_index int").withColumn("display", G.affine(1, 0, 0, 0, 0, 0))
    assert pointer.selection_highlights(ranges, numbered, flat).count() == 0


def test_nothing_to_point_at(spark):
    runs, pages = spark.createDataFrame([], RUNS), spark.createDataFrame([(1, 0, None)], "doc_id int, page_index int, text string")
    lines = pointer.selection_lines(pointer.numbered_runs(runs, pages))
    points = spark.createDataFrame([(1, 0, 1, 0.0, 0.0)], "doc_id int, page_index int, id int, x double, y double")
    assert pointer.text_offsets(points, lines).count() == 0


def test_cache_replay(spark):
    rng = random.Random(2)
    log = [(c, s, rng.randint(0, 12), rng.choice([1, 2, 3, 7, 30])) for c in range(5) for s in range(200)]
    cost = {}  # a key keeps its cost
    log = [(c, s, k, cost.setdefault((c, k), w)) for c, s, k, w in log]
    rng.shuffle(log)
    got = sorted(tuple(r) for r in caches.replay(spark.createDataFrame(log, "cache int, seq int, key int, cost int"), 20).collect())
    want = []
    for c in range(5):
        kept: list[tuple[int, int]] = []
        for _, s, k, w in sorted(x for x in log if x[0] == c):
            hit, gone = any(a == k for a, _ in kept), 0
            if hit:
                kept = [x for x in kept if x[0] != k] + [(k, w)]
            elif w <= 20:
                while sum(b for _, b in kept) + w > 20:
                    kept, gone = kept[1:], gone + 1
                kept.append((k, w))
            want.append((c, s, k, hit, gone, sum(b for _, b in kept)))
    assert got == want


def test_embedded_glyph_map():
    read = content.CidMap.parse
    assert read(b"1 begincidrange <00> <01> 5 endcidrange") is None
    m = read(b"junk ) begincodespacerange <00> <7F> <8000> <FFFF> <09> <02> endcodespacerange begincidrange <20> <40> 1 <8000> <8010> 300 <05> <02> 9 <10> <11> -4 endcidrange begincidchar <30> 77 <31> -1 endcidchar")
    assert list(m.codes(b"\x20\x81\x02\xff")) == [(0x20, 1), (0x8102, 2), (0xFF, 1)]
    assert [m.get(0x20, 1), m.get(0x20, 2), m.get(0x30, 2), m.get(0x31, 1), m.get(0x8003, 2), m.get(5, 1), m.get(0x10, 1)] == [1, None, 77, 18, 303, None, None]
    font = content.Font(two_byte=True, cids=m, widths={1: 250.0}, default_width=900.0)
    assert [(w, space) for _, w, space in font.glyphs(b"\x20\x81\x02")] == [(250.0, True), (900.0, False)]


def test_a_hook_decrypts_streams_before_their_filters():
    data = text_document(["secret"], compress=False)
    turned = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"nopqrstuvwxyzabcdefghijklm")
    seen = []
    doc = pdf.Document.open(data, decrypt=lambda raw: seen.append(raw) or raw.translate(turned))
    assert doc.contents(doc.pages()[0]) == pdf.Document.open(data).contents(doc.pages()[0]).translate(turned) and seen


def test_joined_content_is_cut(monkeypatch):
    doc = pdf.Document.open(text_document(["some text"], compress=False))
    page = doc.pages()[0]
    whole = doc.contents(page)
    page.contents = [page.contents] * 3
    assert doc.contents(page) == b" ".join([whole] * 3)
    monkeypatch.setattr(pdf, "CONTENT_BYTES", len(whole) + 5)
    assert doc.contents(page) == (whole + b" " + whole)[: len(whole) + 5]


def test_groups_carry_their_quads(spark):
    rows = [(0, 1, "r", 1, ["b"]), (0, 0, "r", 1, ["a"]), (0, 2, "g", 2, ["c", "d"])]
    frame = spark.createDataFrame(rows, "page_index int, place int, color string, n_quads bigint, quads array<string>")
    assert sorted((r.group_no, r.color, r.quads) for r in marks.color_groups(frame).collect()) == [(0, "r", ["a", "b"]), (1, "g", ["c", "d"])]


def test_prefetch_leaves_out_what_is_shown(spark):
    frames = layout.page_frames(spark.createDataFrame([(1, p, 600.0, 700.0) for p in range(9)], "doc_id int, page_index int, w double, h double"))
    views = spark.createDataFrame([(1, 0, 0.0, 1500.0, 600.0, 300.0, 0), (1, 1, 0.0, -9000.0, 600.0, 300.0, 0)], "doc_id int, id int, vx double, vy double, vw double, vh double, bucket int")
    shown = {(r.id, r.page_index) for r in layout.visible_parts(views, frames).collect()}
    near = {(r.id, r.page_index) for r in layout.prefetch_previews(views, frames).collect()}
    assert shown == {(0, 2)} and near == {(0, p) for p in (0, 1, 3, 4, 5)}
    assert {r.page_index for r in layout.prefetch_tiles(views, frames).collect()} <= {1, 2, 3}
    assert layout.current_page(views, frames).where(F.col("id") == 0).first().page_index == 2


def test_cut_text_leaves_whole_characters(spark):
    texts = ["", "abc", "ab\U0001f600c", "e\u0301e\u0301e\u0301", "a\r\nb", "\U0001d400" * 4, "ab\u200dc", None]
    for units, want in [
        (1, ["", "a", "a", "", "a", "", "a", None]),
        (2, ["", "ab", "ab", "e\u0301", "a", "\U0001d400", "a", None]),
        (3, ["", "abc", "ab", "e\u0301", "a\r\n", "\U0001d400", "ab\u200d", None]),
        (8, texts),
    ]:
        out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", selection.cut_text(F.col("text"), units).alias("t")).collect()
        assert [r.t for r in sorted(out)] == want, units


def test_sanitize_runs_equals_a_plain_walk(spark):
    rng, inf, nan = random.Random(9), float("inf"), float("nan")
    pages = [(d, 0, "ab\U0001f600" * rng.randint(0, 8)) for d in range(40)] + [(99, 0, None)]
    runs = []
    for d, _, _ in pages[:-1] + [(99, 0, None), (100, 0, "no page")]:
        at = -3
        for seq in range(rng.randint(0, 9)):
            at = at + rng.randint(0, 6) if d % 3 else rng.randint(-5, 35)
            hi = at + rng.randint(-2, 9)
            n = max(0, hi - at) + rng.choice([0, 0, 0, -1, 1])
            advances = None if rng.random() < 0.1 else [rng.choice([1.5, 2.0, 0.0] + [nan, inf, -1.0] * (rng.random() < 0.2)) for _ in range(max(0, n))]
            quad = [(rng.choice([0.0] * 30 + [nan, inf]), float(k)) for k in range(4)]
            runs.append((d, 0, seq, at, hi, quad, advances))
    fields = "doc_id int, page_index int, seq int, run_lo int, run_hi int, quad array<struct<x:double,y:double>>, advances array<double>"
    given = spark.createDataFrame(runs, fields).withColumn("extra", F.col("seq") + 1).repartition(3)
    out = selection.sanitize_runs(given, spark.createDataFrame(pages, "doc_id int, page_index int, text string"), glyph_cap=20, text_cap=19)
    got = sorted((r.doc_id, r.run_no, r.seq, r.run_lo, r.run_hi, r.advances, r.extra) for r in out.collect())
    want = []
    for d, _, text in pages:
        n = min(len((text or "").encode("utf-16-le")) // 2, 19)
        n, kept, total = 18 if n == 19 else n, [], 0
        for _, _, seq, a, b, quad, advances in sorted((r for r in runs if r[0] == d), key=lambda r: r[2]):
            lo = min(max(a, 0), n)
            hi, x = min(max(b, lo), n), advances or []
            if text is None or hi == lo or any(not abs(v) < inf for p in quad for v in p):
                continue
            if (lo, hi) != (a, b) and hi - a <= len(x):
                x = x[lo - a : hi - a]
            if len(x) != hi - lo or not all(0 <= v < inf for v in x):
                x = [1.0] * (hi - lo)
            total += hi - lo
            if total > 20:
                break
            kept.append((lo, hi, seq, x))
        if any(q[0] < p[0] for p, q in zip(kept, kept[1:])):
            kept.sort(key=lambda r: r[:3])
        want += [(d, k, seq, lo, hi, x, seq + 1) for k, (lo, hi, seq, x) in enumerate(kept)]
    assert got == sorted(want) and len(got) > 40


def test_places_of_selections_are_utf16_units(spark):
    rng = random.Random(4)
    rows = [(d, p, "".join(rng.choice(["a", "\U0001f600", "é", "\n", "b"]) for _ in range(rng.randint(0, 12)))) for d in range(30) for p in range(3)]
    pages = spark.createDataFrame(rows, "doc_id int, page_index int, text string")
    ends = [(d, rng.randint(0, 1), rng.randint(0, 14), 2, rng.randint(0, 14)) for d in range(30)]
    chosen = spark.createDataFrame(ends, "doc_id int, a int, b int, c int, d int").select("doc_id", selection.normal_selection(*map(F.col, "abcd")).alias("selection"))
    got = {r.doc_id: r.selected for r in selection.selected_strings(selection.page_ranges(chosen, pages)).collect()}
    lines = {(r.doc_id, r.page_index, r.line_no): (r.lo, r.hi) for r in selection.text_lines(pages).collect()}

    def part(text, lo, hi):
        at, out = 0, ""
        for c in text:
            n = 2 if ord(c) > 0xFFFF else 1
            out += c if lo <= at and at + n <= hi else ""
            at += n
        return out

    for d, a, b, c, e in ends:
        assert got[d] == "\n".join(part(t, b if p == a else 0, e if p == c else 99) for i, p, t in rows if i == d and a <= p <= c)
    for d, p, text in rows:
        at = 0
        for k, line in enumerate(text.split("\n")):
            n = len(line.encode("utf-16-le")) // 2
            assert lines[d, p, k] == (at, at + n)
            at += n + 1


def test_codes_are_cut_as_a_plain_walk_does():
    """Any codespaces: the shortest one that holds the next bytes, else one byte."""
    from quire.sources.content import CidMap

    rng = random.Random(2)
    for k in range(300):
        spaces = []
        for _ in range(rng.choice((1, 2, 3, 8, 600 if k % 50 == 0 else 5))):
            n = rng.randint(1, 5)
            ends = sorted(int.from_bytes(bytes(rng.choice((0, 1, 2, 10, 91, 92, 93, 254, 255)) for _ in range(n)), "big") for _ in "ab")
            spaces.append((n, *ends))
        b = bytes(rng.choice((0, 1, 2, 3, 10, 91, 92, 93, 200, 254, 255)) for _ in range(60))
        want, at = [], 0
        while at < len(b):
            fits = (n for n in range(1, min(4, len(b) - at) + 1) if any(m == n and lo <= int.from_bytes(b[at : at + n], "big") <= hi for m, lo, hi in spaces))
            n = next(fits, 1)
            want.append((int.from_bytes(b[at : at + n], "big"), n))
            at += n
        assert list(CidMap(spaces).codes(b)) == want, spaces


def test_a_text_is_cut_at_once():
    """A million codes take a fraction of a second (4 seconds and more when each was sought in every codespace)."""
    import time

    from quire.plans.reader import _CMAP
    from quire.sources.content import CidMap

    cmap, text = CidMap.parse(_CMAP), ("aé€😀" * 250_000).encode()
    began = time.process_time()
    assert len(cmap.pieces(text)) == 1_000_000
    assert time.process_time() - began < 1.5
