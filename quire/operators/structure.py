"""Document structure over tables of objects: sections, references, page trees, metadata, outlines, fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..limits import PAGES, REFERENCE_HOPS, TREE_DEPTH


def first_wins(entries: DataFrame, keys: list[str], rank: str, tie: str) -> DataFrame:
    """The entry of the newest section (least rank) of each key, the later one within a section."""
    order = W.partitionBy(*keys).orderBy(F.col(rank), F.col(tie).desc())
    return entries.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def latest_wins(found: DataFrame, keys: list[str], offset: str, value: list[str]) -> DataFrame:
    """Of objects found by a scan, the one at the greatest offset of each key."""
    out = found.groupBy(*keys).agg(F.max_by(F.struct(offset, *value), offset).alias("_v"))
    return out.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in (offset, *value)))


def valid_entries(entries: DataFrame, bias: Column, length: Column) -> DataFrame:
    """Entries with their offset moved by ``bias`` that lie inside the file."""
    return entries.withColumn("offset", F.col("offset") + bias).where((F.col("offset") >= 0) & (F.col("offset") < length))


def follow(references: DataFrame, hops: int = REFERENCE_HOPS) -> DataFrame:
    """(id, target, hops): where chains of references (id, next; null ends a chain) end, within ``hops`` steps;
    null for longer and circular ones.

    Doubling: each step joins the table of jumps with itself, so 32 hops take five joins.
    """
    jumps = references.select("id", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("n"))
    steps = 1
    while steps < 2 * hops:
        more = jumps.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        met = jumps.join(more, "to", "left")
        jumps = met.select("id", F.when(F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("to")).alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        steps *= 2
    ok = F.col("n") <= hops
    return jumps.select("id", F.when(ok, F.coalesce("to", "id")).alias("target"), F.when(ok, F.col("n")).alias("hops"))


def flatten_tree(spark, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves of trees in reading order with attributes inherited from above.

    ``nodes``: doc_id, parent, ordinal, child, leaf (boolean), media, rotate; ``roots``: doc_id, child, media,
    rotate. Every child is referenced once. Returns doc_id, page_index, child, media, rotate.
    """
    nodes.createOrReplaceTempView("_tree_nodes")
    roots.createOrReplaceTempView("_tree_roots")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(TREE_DEPTH + 1))
    spark.conf.set("spark.sql.cteRecursionRowLimit", str(10 * PAGES))
    walked = spark.sql("""
        WITH RECURSIVE walk(doc_id, child, leaf, media, rotate, path) AS (
            SELECT doc_id, child, false, media, rotate, array(cast(0 AS bigint)) FROM _tree_roots
            UNION ALL
            SELECT n.doc_id, n.child, n.leaf, coalesce(n.media, w.media), coalesce(n.rotate, w.rotate), array_append(w.path, cast(n.ordinal AS bigint))
            FROM walk w JOIN _tree_nodes n ON n.doc_id = w.doc_id AND n.parent = w.child WHERE NOT w.leaf
        ) SELECT * FROM walk WHERE leaf
    """)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1
    return walked.select("doc_id", number.alias("page_index"), "child", "media", "rotate")


def merged_metadata(info: DataFrame, xmp: DataFrame, key: str = "doc_id") -> DataFrame:
    """Field by field what ``info`` says, and where it says nothing what ``xmp`` does."""
    fields = [c for c in info.columns if c != key]
    other = xmp.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    both = info.join(other, key, "full_outer")
    return both.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in fields))


def parsed_iso_date(text: Column) -> Column:
    """A date of a metadata packet (year, then month, day, time and zone as far as given) as a UTC timestamp; null
    if it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^\s*(\d{4})-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?\s*$", k), F.lit(""))
    number = lambda k, least: F.coalesce(part(k).cast("int"), F.lit(least))
    local = F.try_make_timestamp(number(1, None), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0).cast("double"))
    zone = part(7)
    shift = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int")) * F.when(zone.startswith("-"), -60).otherwise(60)
    return F.timestamp_seconds(F.unix_seconds(local) - F.when(zone.isNull() | (zone == "Z"), 0).otherwise(shift))


def parsed_date(text: Column) -> Column:
    """A date string as a UTC timestamp. The year is needed; fields are read from the left, the first that is
    missing or out of range stops the reading, and the rest takes its least value. An offset, apostrophes
    optional, is applied; without one the time is UTC. Days over a month's length roll over."""
    body = F.regexp_replace(text, "^D:", "")
    digits = F.regexp_extract(body, r"^\d{0,14}", 0)
    year = F.when(F.length(digits) >= 4, F.substring(digits, 1, 4).cast("int"))
    ok, parts = year.isNotNull(), []
    for at, lo, hi in ((5, 1, 12), (7, 1, 31), (9, 0, 23), (11, 0, 59), (13, 0, 59)):
        v = F.when(F.length(digits) >= at + 1, F.substring(digits, at, 2).cast("int"))
        ok = ok & F.coalesce((v >= lo) & (v <= hi), F.lit(False))
        parts.append(F.when(ok, v).otherwise(lo))
    month, day, hour, minute, second = parts
    rest = F.substring(body, F.length(digits) + 1, F.lit(8))
    offset = r"^([+-])(\d{2})'?(\d{2})?'?"
    sign = F.regexp_extract(rest, offset, 1)
    hours = F.coalesce(F.nullif(F.regexp_extract(rest, offset, 2), F.lit("")).cast("int"), F.lit(0))
    minutes = F.coalesce(F.nullif(F.regexp_extract(rest, offset, 3), F.lit("")).cast("int"), F.lit(0))
    shift = F.when(sign == "", 0).when(sign == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    start = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))
    seconds = ((day - 1) * 86400 + hour * 3600 + (minute - F.when(ok, shift).otherwise(0)) * 60 + second).cast("bigint")
    return F.timestamp_seconds(F.unix_seconds(start) + seconds)


# The kind that a warning belongs to; what isn't named here is of kind parsing.
WARNING_KINDS = {
    "header": ("headerOffset", "version", "endMark"),
    "crossReference": ("sections", "sectionCycle", "section", "hybrid", "entryOffset", "rowWidth", "sectionShort"),
    "recovery": ("recovered",),
    "objectStream": ("objectStream", "member"),
}


def warning_kind(warning: Column) -> Column:
    """The kind of a warning (its code, then what it is about)."""
    kinds = F.create_map(*(F.lit(x) for kind, codes in WARNING_KINDS.items() for code in codes for x in (code, kind)))
    return F.when(warning.isNotNull(), F.coalesce(F.try_element_at(kinds, F.split_part(warning, F.lit(" "), F.lit(1))), F.lit("parsing")))


def greatest_version(*versions: Column) -> Column:
    """The greatest of 'major.minor' texts as pairs of numbers; malformed ones don't count."""
    pairs = [F.when(v.rlike(r"^\d{1,2}\.\d{1,2}$"), F.struct(F.split_part(v, F.lit("."), F.lit(1)).cast("int").alias("a"), F.split_part(v, F.lit("."), F.lit(2)).cast("int").alias("b"))) for v in versions]
    best = F.greatest(*pairs) if len(pairs) > 1 else pairs[0]
    return F.concat_ws(".", best["a"].cast("string"), best["b"].cast("string"))


def in_ranges(keys: DataFrame, ranges: DataFrame, by: list[str], key: str, choose: str, largest: bool) -> DataFrame:
    """Each key with the value of the range (lo to hi) that holds it, the last or the first by ``choose``; null
    if none does. ``by`` are equal on both sides.

    A hash join by cells: a range lies in one or two cells of the least power of four that is longer than it, and a key
    in one cell of each such length in use, so that it meets only ranges near it, whatever their lengths.
    """
    shifted = lambda c: F.call_function("shiftright", F.floor(c).cast("bigint"), F.col("_bits"))
    n = F.length(F.bin((F.floor("hi") - F.floor("lo")).cast("bigint")))
    placed = ranges.where("lo <= hi").withColumn("_bits", n + n % 2)
    used = placed.select("_bits").distinct().agg(F.collect_list("_bits").alias("_used"))  # some 30 at most
    placed = placed.withColumn("_cell", F.explode(F.array_distinct(F.array(shifted("lo"), shifted("hi")))))
    asked = keys.select(*by, key).distinct().crossJoin(F.broadcast(used)).withColumn("_bits", F.explode("_used")).drop("_used").withColumn("_cell", shifted(key))
    met = asked.join(placed, [*by, "_bits", "_cell"]).where((F.col(key) >= F.col("lo")) & (F.col(key) <= F.col("hi")))
    pick = F.max_by if largest else F.min_by
    best = met.groupBy(*by, key).agg(pick("value", choose).alias("value"))
    return keys.join(best, [*by, key], "left")


def overlaid_encoding(items: DataFrame, base: DataFrame) -> DataFrame:
    """A base encoding (code, glyph) under differences (font, seq, number, glyph): a number sets the code, each
    glyph takes the next one; codes outside 0 to 255 don't count, later ones win."""
    order = W.partitionBy("font").orderBy("seq")
    rows = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    set_at = F.last(F.when(F.col("number").isNotNull(), F.col("seq")), ignorenulls=True).over(rows)
    start = F.last("number", ignorenulls=True).over(rows)
    named = items.withColumn("code", (start + F.col("seq") - set_at - 1).cast("int")).where("glyph is not null and code between 0 and 255")
    named = named.groupBy("font", "code").agg(F.max_by("glyph", "seq").alias("own"))
    fonts = items.select("font").distinct()
    all_codes = fonts.select("font", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("code"))  # 256 rows a font
    out = all_codes.join(F.broadcast(base), "code", "left").join(named, ["font", "code"], "left")
    return out.select("font", "code", F.coalesce("own", "glyph").alias("glyph")).where("glyph is not null")


def glyph_unicode(name: Column, table: dict[str, str]) -> Column:
    """The text of a glyph name: by a table, as uniXXXX or uXXXX to uXXXXXX, or a single character itself."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name] if table else F.lit(None).cast("string")
    hexa = F.coalesce(F.nullif(F.regexp_extract(name, "^uni([0-9A-F]{4})$", 1), F.lit("")), F.nullif(F.regexp_extract(name, "^u([0-9A-F]{4,6})$", 1), F.lit("")))
    code = F.conv(hexa, 16, 10).cast("int")
    valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    text = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(known, text, F.when(F.length(name) == 1, name))


def header_facts(files: DataFrame) -> DataFrame:
    """What the ends of files (doc_id, content) tell: the header's place, the version (1.4 if it can't be read),
    whether an end mark stands in the last 1,024 bytes, and the last startxref value there."""
    tail = F.expr("right(content, 1024)")
    start = F.expr("position(x'255044462D' in substring(content, 1, 1024))")
    version = F.nullif(F.regexp_extract(F.decode(F.expr("substring(content, _at, 16)"), "ISO-8859-1"), r"^%PDF-(\d{1,2}\.\d{1,2})(?!\d)", 1), F.lit(""))
    text = F.decode(tail, "ISO-8859-1")
    values = F.regexp_extract_all(text, F.lit(r"startxref\s*(\d{0,18})"), F.lit(1))
    out = files.withColumn("_at", start)
    return out.select(
        "doc_id",
        (F.col("_at") - 1).alias("header_offset"),
        F.when(F.col("_at") > 0, F.coalesce(version, F.lit("1.4"))).alias("version"),
        F.expr("position(x'2525454F46' in right(content, 1024))").cast("boolean").alias("has_end"),
        F.nullif(F.element_at(F.when(F.size(values) > 0, values), -1), F.lit("")).cast("bigint").alias("startxref"),
    )
