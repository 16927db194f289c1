"""Search, selection and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import word_at
from ..operators import search as S
from ..operators import selection as L
from .registry import query


def document_pages(t):
    return t.documents.select("doc_id", F.lit(0).alias("page_index"), "text")


def turns(t):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text")


def _count_sql(query: str, folded: str) -> str:
    return f"""
        SELECT doc_id, CAST(0 AS INTEGER) AS page_index, CAST((length(f) - length(replace(f, '{query}', ''))) / {len(query)} AS BIGINT) AS n
        FROM (SELECT doc_id, {folded} AS f FROM documents) WHERE contains(f, '{query}')"""


FOLDED = "strip_accents(lower(text))"


@query(_count_sql("de", FOLDED))
def search_count(t):
    return S.count_matches(document_pages(t), "de")


@query(_count_sql("The", "strip_accents(text)"))
def search_case_sensitive(t):
    return S.count_matches(document_pages(t), " The ", S.Options(case_sensitive=True))


@query(_count_sql("é", "lower(text)"))
def search_diacritic_sensitive(t):
    return S.count_matches(document_pages(t), "É", S.Options(diacritic_sensitive=True))


def _matches_sql(query: str, pages: str) -> str:
    """All matches of a folded query in pages(doc_id, page_index, text)."""
    n = len(query)
    return f"""
        p AS ({pages}),
        s AS (SELECT *, string_split({FOLDED}, '{query}') AS parts FROM p),
        k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM s),
        m AS (SELECT doc_id, page_index, text, CAST(k - 1 AS INTEGER) AS match_no,
                     CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * {n} AS BIGINT) AS lo FROM k)"""


@query(
    f"""WITH {_matches_sql("ete", "SELECT doc_id, CAST(0 AS INTEGER) AS page_index, text FROM documents")}
        SELECT doc_id, page_index, match_no, lo, lo + 3 AS hi,
               translate(substring(text, greatest(lo - 40, 0) + 1, least(lo + 43, length(text)) - greatest(lo - 40, 0)), chr(10) || chr(13) || chr(9), '   ') AS snippet,
               CAST(lo - greatest(lo - 40, 0) AS INTEGER) AS snip_lo, CAST(lo + 3 - greatest(lo - 40, 0) AS INTEGER) AS snip_hi
        FROM m WHERE match_no < 1000"""
)
def search_matches(t):
    return S.search(document_pages(t), " été\n")


@query(
    f"""WITH {_matches_sql("e", "SELECT source AS doc_id, doc_id AS page_index, text FROM documents")},
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, lo) AS r FROM m WHERE match_no < 1000)
        SELECT doc_id, page_index, count(*) AS n, min(lo) AS first_lo, max(lo) AS last_lo FROM c WHERE r <= 10000 GROUP BY ALL"""
)
def search_caps(t):
    pages = t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), "text")
    found = S.search(pages, "e", snippets=False)
    return found.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("first_lo"), F.max("lo").alias("last_lo"))


_TURNS = "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_index, text FROM conversations"


@query(f"WITH {_matches_sql('tion', _TURNS)} SELECT doc_id, page_index, match_no, lo, lo + 4 AS hi FROM m")
def search_conversations(t):
    return S.search(turns(t), "TION").select("doc_id", "page_index", "match_no", "lo", "hi")


@query(
    f"""WITH {_matches_sql("tion", _TURNS)},
        f AS (SELECT doc_id, page_index, lo, CAST(row_number() OVER w - 1 AS INTEGER) AS flat, count(*) OVER (PARTITION BY doc_id) AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, lo))
        SELECT doc_id, page_index, lo, flat, flat = 0 AS selected, CAST((flat + 1) % n AS BIGINT) AS after, CAST((flat - 1 + n) % n AS BIGINT) AS before FROM f"""
)
def match_nav(t):
    found = S.flat_index(S.search(turns(t), "tion").select("doc_id", "page_index", "lo"))
    from pyspark.sql.window import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    return found.withColumns({"after": S.advance(F.col("flat"), 1, n), "before": S.advance(F.col("flat"), -1, n)})


@query(
    f"""WITH {_matches_sql("tion", _TURNS)}
        SELECT doc_id, page_index, count(*) AS n, min(lo) AS first_lo, max(lo) + 4 AS last_hi FROM m GROUP BY ALL"""
)
def matches_by_page(t):
    pages = S.by_page(S.search(turns(t), "tion"))
    return pages.select("doc_id", "page_index", "n", F.col("ranges")[0]["lo"].alias("first_lo"), F.element_at("ranges", -1)["hi"].alias("last_hi"))


@query(
    """SELECT coalesce(d.doc_id, b.item_id) AS doc_id, CAST(0 AS INTEGER) AS page_index, coalesce(d.text, b.text) AS text
       FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text END AS text FROM documents) d FULL JOIN benchmark b ON d.doc_id = b.item_id"""
)
def provider_fallback(t):
    provider = document_pages(t).withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return S.provided(provider, t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), "text"))


@query(
    """WITH r AS (SELECT conv_id, turn, text,
                    CASE WHEN turn = 0 THEN least(5 + conv_id % 7, length(text)) ELSE 0 END AS lo,
                    CASE WHEN turn = 2 THEN least(11, length(text)) ELSE length(text) END AS hi
             FROM conversations WHERE turn BETWEEN 0 AND 2)
       SELECT conv_id AS doc_id, string_agg(substring(text, lo + 1, hi - lo), chr(10) ORDER BY turn) AS selected FROM r GROUP BY conv_id"""
)
def selected_text(t):
    a = (F.lit(0), (F.col("conv_id") % 7 + 5).cast("int"))
    b = (F.lit(2), F.lit(11))
    odd = F.col("conv_id") % 2 == 1  # dragged upwards
    ends = [F.when(odd, y).otherwise(x) for x, y in zip((*a, *b), (*b, *a), strict=True)]
    chosen = t.conversations.select("conv_id").distinct().select(F.col("conv_id").alias("doc_id"), L.normal_selection(*ends).alias("selection"))
    return L.selected_strings(L.page_ranges(chosen, turns(t)))


@query(
    """SELECT user_id, CAST(len(list_distinct(list_concat(
              list_filter(range(user_id % 9, user_id % 9 + 5), lambda x: NOT list_contains(range(user_id % 5, user_id % 5 + 6), x)),
              list_filter(range(user_id % 5, user_id % 5 + 6), lambda x: NOT list_contains(range(user_id % 9, user_id % 9 + 5), x)),
              [user_id % 5]))) AS INTEGER) AS n_changed FROM (SELECT DISTINCT user_id FROM events)"""
)
def selection_diff(t):
    lo, new = F.col("user_id") % 9, F.col("user_id") % 5
    changed = L.changed_pages(F.sequence(lo, lo + 4), F.sequence(new, new + 5), F.array(new))
    return t.events.select("user_id").distinct().select("user_id", F.size(changed).alias("n_changed"))


_WORDS = """
        w AS (SELECT item_id, text, string_split(text, ' ') AS parts FROM benchmark),
        r AS (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM w),
        runs AS (SELECT item_id, parts[k] AS word, CAST(k - 1 AS INTEGER) AS run_no, CAST(coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS run_lo FROM r)"""


def word_runs(t):
    """The words of each benchmark text as runs of 10 wide characters on one line."""
    from pyspark.sql.window import Window as W

    parts = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), F.posexplode(F.split("text", " ")).alias("run_no", "word"))
    before = F.sum(F.length("word") + 1).over(W.partitionBy("doc_id").orderBy("run_no").rowsBetween(W.unboundedPreceding, -1))
    lo = F.coalesce(before, F.lit(0))
    runs = parts.withColumns({"run_lo": lo, "run_hi": lo + F.length("word")}).where("run_hi > run_lo")
    box = G.rect(F.col("run_lo") * 10.0, F.lit(700.0), F.length("word") * 10.0, F.lit(12.0))
    return runs.withColumns({"quad": G.quad_of(box), "advances": F.array_repeat(F.lit(10.0), F.length("word"))})


@query(
    f"""WITH {_WORDS},
        g AS (SELECT DISTINCT item_id, a.lo, a.lo + 9 AS hi FROM benchmark, (SELECT unnest([0, 7, 31, 64, 200]) AS lo) a)
        SELECT g.item_id AS doc_id, g.lo, g.hi, run_no, CAST(greatest(g.lo, run_lo) * 10.0 AS DOUBLE) AS x, CAST((least(g.hi, run_lo + length(word)) - greatest(g.lo, run_lo)) * 10.0 AS DOUBLE) AS w, CAST(12.0 AS DOUBLE) AS h
        FROM g JOIN runs r ON r.item_id = g.item_id AND g.lo < run_lo + length(word) AND run_lo < g.hi WHERE length(word) > 0"""
)
def range_quads(t):
    ranges = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), F.explode(F.array(*(F.lit(x) for x in (0, 7, 31, 64, 200)))).alias("lo"))
    found = L.quads_for_ranges(ranges.withColumn("hi", F.col("lo") + 9), word_runs(t))
    box = G.bounds(F.col("part"))
    return found.select("doc_id", "lo", "hi", "run_no", F.round(box["x"], 6).alias("x"), F.round(box["w"], 6).alias("w"), F.round(box["h"], 6).alias("h"))


@query(
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 >= 5 THEN 18 ELSE 4 * (o_custkey % 9) END AS n FROM orders),
       r AS (SELECT l_orderkey, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS seq, l_partkey % 24 - 4 AS a, l_partkey % 24 - 4 + l_suppkey % 13 AS b, n,
                    list_transform(range((l_linenumber * 3 + l_partkey) % 13), lambda i: ((i + l_linenumber) % 7 - CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) * 0.5) AS adv
             FROM lineitem JOIN p ON l_orderkey = o_orderkey WHERE l_suppkey % 11 <> 0),
       c AS (SELECT *, least(greatest(a, 0), n) AS lo, least(greatest(b, least(greatest(a, 0), n)), n) AS hi FROM r),
       d AS (SELECT *, CASE WHEN (lo <> a OR hi <> b) AND hi - a <= len(adv) THEN adv[lo - a + 1:hi - a] ELSE adv END AS x FROM c WHERE lo < hi),
       e AS (SELECT *, CASE WHEN len(x) = hi - lo AND list_min(x) >= 0 THEN list_sum(x) ELSE hi - lo END AS width, sum(hi - lo) OVER (PARTITION BY l_orderkey ORDER BY seq) AS s FROM d),
       f AS (SELECT *, coalesce(lag(lo) OVER (PARTITION BY l_orderkey ORDER BY seq) > lo, false) AS back FROM e WHERE s <= 25),
       g AS (SELECT *, bool_or(back) OVER (PARTITION BY l_orderkey) AS sorted FROM f)
       SELECT l_orderkey AS doc_id, CAST(seq AS BIGINT) AS seq, CAST(lo AS BIGINT) AS run_lo, CAST(hi AS BIGINT) AS run_hi, CAST(width AS DOUBLE) AS width,
              CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN sorted THEN lo END, CASE WHEN sorted THEN hi END, seq) - 1 AS INTEGER) AS run_no FROM g"""
)
def sanitize_runs(t):
    """Pages of letters and pairs, cut in the middle of a pair; runs beyond the text with advances of all kinds."""
    pages = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.expr("repeat('ab\U0001f600', cast(o_custkey % 9 as int))").alias("text"))
    lo, x = F.expr("l_partkey % 24 - 4"), F.expr("if(l_suppkey % 11 = 0, double('nan'), 1.0d)")
    advances = F.expr("""transform(filter(sequence(0, 12), i -> i < (l_linenumber * 3 + l_partkey) % 13),
        i -> cast((i + l_linenumber) % 7 - if(l_partkey % 3 = 0, 1, 0) as double) * 0.5d)""")
    runs = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.expr("l_linenumber * 10000000000L + l_partkey * 100000 + l_suppkey").alias("seq"),
        lo.cast("bigint").alias("run_lo"), (lo + F.expr("l_suppkey % 13")).cast("bigint").alias("run_hi"),
        F.array(*[G.point(x, F.lit(float(k))) for k in range(4)]).alias("quad"), advances.alias("advances"),
    )
    out = L.sanitize_runs(runs, pages, glyph_cap=25, text_cap=19)
    return out.select("doc_id", "seq", "run_lo", "run_hi", F.aggregate("advances", F.lit(0.0), lambda s, a: s + a).alias("width"), "run_no")


_LINES = """
        s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations),
        u AS (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS k FROM s),
        lines AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(k - 1 AS INTEGER) AS line_no, CAST(coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS lo, length(parts[k]) AS n FROM u)"""


@query(
    f"""WITH {_LINES}, o AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST((conv_id * 37 + turn * 11) % 400 AS BIGINT) AS pos FROM conversations),
        m AS (SELECT o.*, l.line_no, l.lo, l.lo + l.n AS hi, row_number() OVER (PARTITION BY o.conv_id, o.turn ORDER BY l.lo DESC) AS r FROM o JOIN lines l ON o.conv_id = l.conv_id AND o.turn = l.turn AND l.lo <= o.pos)
        SELECT conv_id AS doc_id, turn AS page_index, pos AS "offset", line_no, lo, hi FROM m WHERE r = 1"""
)
def line_of_offset(t):
    pages = turns(t)
    offsets = pages.select("doc_id", "page_index", F.lit(0).alias("id"), ((F.col("doc_id") * 37 + F.col("page_index") * 11) % 400).cast("bigint").alias("offset"))
    out = L.line_of_offset(offsets, L.text_lines(pages))
    return out.select("doc_id", "page_index", "offset", *(F.col(f"line.{c}").alias(c) for c in ("line_no", "lo", "hi")))


@query(
    f"""WITH {_LINES},
        b AS (SELECT *, line_no * 20.0 AS y0, line_no * 20.0 + 12.0 AS y1 FROM lines),
        p AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST((conv_id * 13 + turn * 7) % 300 AS DOUBLE) AS x, CAST((conv_id * 29 + turn * 3) % 90 AS DOUBLE) AS y FROM conversations),
        m AS (SELECT p.*, b.line_no, b.lo, b.n, greatest(0, y0 - y, y - y1) AS band, greatest(0, y0 - y, y - y1) + greatest(0, 10 - x, x - (10 + n * 4.0)) AS full_d FROM p JOIN b ON p.conv_id = b.conv_id AND p.turn = b.turn),
        near AS (SELECT *, first_value(line_no) OVER (PARTITION BY conv_id, turn ORDER BY band, line_no) AS near FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY full_d, line_no) AS r FROM near WHERE abs(line_no - near) <= 4)
        SELECT conv_id AS doc_id, turn AS page_index, line_no, CAST(lo + least(greatest(floor((x - 10) / 4.0 + 0.5), 0), n) AS BIGINT) AS "offset" FROM r WHERE r = 1"""
)
def hit_test(t):
    lines = L.text_lines(turns(t)).withColumns({"y0": F.col("line_no") * 20.0, "y1": F.col("line_no") * 20.0 + 12.0, "x0": F.lit(10.0), "advance": F.lit(4.0)})
    points = turns(t).select("doc_id", "page_index", F.lit(0).alias("id"), ((F.col("doc_id") * 13 + F.col("page_index") * 7) % 300).cast("double").alias("x"), ((F.col("doc_id") * 29 + F.col("page_index") * 3) % 90).cast("double").alias("y"))
    return L.hit_test(points, lines).select("doc_id", "page_index", "line_no", F.col("offset").cast("bigint").alias("offset"))


@query(
    """WITH q AS (SELECT l_orderkey, l_suppkey % 4 AS line_no, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 9 AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) AS w, 12.0 AS h FROM lineitem)
       SELECT l_orderkey AS doc_id, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM q GROUP BY ALL"""
)
def line_union_quads(t):
    parts = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("id"), (F.col("l_suppkey") % 4).alias("line_no"),
        (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 9).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("w"), F.lit(12.0).alias("h"),
    )
    return L.merged_quads(parts).select("doc_id", "line_no", "x", "y", "w", "h")


@query(
    r"""WITH d AS (SELECT item_id, text, CAST(item_id * 17 % 60 AS INTEGER) AS o FROM benchmark),
        c AS (SELECT item_id, o, unnest(range(1, length(text) + 1)) AS i, text FROM d),
        e AS (SELECT item_id, o, i, regexp_matches(substring(text, i, 1), '[\p{L}\p{N}]') AS is_w, i > 1 AND regexp_matches(substring(text, i - 1, 1), '[\p{L}\p{N}]') AS was FROM c),
        g AS (SELECT *, sum(CASE WHEN is_w AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS g FROM e),
        w AS (SELECT item_id, o, g, min(i) - 1 AS lo, max(i) AS hi FROM g WHERE is_w GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN o >= lo AND o < hi THEN -1 ELSE greatest(0, lo - o, o - hi) END, lo DESC) AS r FROM w)
        SELECT item_id, o AS "offset", CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM r WHERE r = 1"""
)
def word_range(t):
    found = t.benchmark.select("item_id", (F.col("item_id") * 17 % 60).cast("int").alias("offset"), "text")
    found = found.withColumn("w", word_at(F.col("text"), F.col("offset")))
    return found.select("item_id", "offset", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).where("lo is not null")
