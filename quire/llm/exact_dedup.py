"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into fixed-size byte blocks. Equal blocks get one integer name: blocks are
pre-aggregated by a 64-bit key, sorted within the key's partition and numbered; blocks that share a key
but differ get different numbers, so a name is never shared by two contents. Then adjacent names are
paired and the pairs named, level by level, until each document has one name. Two texts are equal
exactly if level and name agree.

Hot blocks (a third of all rows may be one text) shrink in the map-side combine; the joins that send
names back have the long side split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACES, is_numbered, keyed, written

BLOCK = 1024


def normalised(text: str = "text"):
    """UTF-8 bytes of the text after every white-space run became one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ").cast("binary")


def block_key(block: str):
    """The key that brings equal blocks together; different blocks may share one."""
    return F.xxhash64(block)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block. Binary substrings are cut at an offset, so long texts cost linear time."""
    n = F.greatest(F.lit(1), F.ceil(F.length("_norm") / F.lit(size))).cast("int")
    cut = rows.select(ROW, "_norm", n.alias("_m"))
    cut = cut.select(ROW, "_norm", "_m", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i"))
    block = F.expr(f"substring(_norm, _i * {size} + 1, {size})")
    return cut.select(ROW, "_m", "_i", block.alias("_block")).withColumn("_h", block_key("_block"))


def _name_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(row, number of blocks, position, name) of every block."""
    blocks = _blocks(rows, size)
    sets = blocks.groupBy("_h").agg(F.array_sort(F.collect_set("_block")).alias("_set"))
    named = sets.select("_h", F.size("_set").alias("_same"), F.explode("_set").alias("_block"))
    named = named.sortWithinPartitions("_h", "_block").select(
        "_h", F.monotonically_increasing_id().alias("_name"), "_same", F.when(F.col("_same") > 1, F.col("_block")).alias("_block")
    )
    named = written(named, "block-names")
    once = named.where("_same = 1").select("_h", "_name")
    out = blocks.select(ROW, "_m", "_i", "_h").join(once, "_h").select(ROW, "_m", "_i", "_name")
    clash = named.where("_same > 1").select("_h", "_block", "_name")
    if not clash.isEmpty():  # different blocks under one key: these alone are joined by content
        out = out.unionByName(blocks.join(clash, ["_h", "_block"]).select(ROW, "_m", "_i", "_name"))
    return written(out, "level-0")


def identities(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, level, name): two rows agree in both exactly if their ``_norm`` bytes are equal."""
    level, now = 0, _name_blocks(rows, size)
    most = now.agg(F.max("_m")).first()[0] or 1
    done = [now.where("_m = 1").select(ROW, F.lit(0).alias("_level"), "_name")]
    while most > 1:
        level += 1
        side = lambda k: F.max(F.when(F.col("_i") % 2 == k, F.col("_name")))
        pairs = now.where("_m > 1").groupBy(ROW, (F.col("_i") / 2).cast("int").alias("_j")).agg(
            F.first("_m").alias("_m"), side(0).alias("_a"), F.coalesce(side(1), F.lit(-1)).alias("_b")
        )
        pairs = written(pairs, f"pairs-{level}")
        names = pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions("_a", "_b")
        names = written(names.select("_a", "_b", F.monotonically_increasing_id().alias("_name")), f"names-{level}")
        now = pairs.join(names, ["_a", "_b"]).select(
            ROW, F.ceil(F.col("_m") / 2).cast("int").alias("_m"), F.col("_j").alias("_i"), "_name"
        )
        now = written(now, f"level-{level}")
        done.append(now.where("_m = 1").select(ROW, F.lit(level).alias("_level"), "_name"))
        most = (most + 1) // 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """Groups of documents whose texts are equal up to the length of white-space runs.

    Returns one row per input row: ``id_col``, ``keep_id`` (smallest id of the group), ``group_size``,
    ``kept`` (true for one row of each group) and ``text_sha256`` of the normalised text.

    Null texts count as empty and so equal each other and empty texts. Rows with repeated or null ids
    are documents of their own: of equal texts the row that sorts first by id (nulls last) stays.
    An empty table gives an empty result. Other columns are not read.
    """
    ident = "_id" if id_col != ROW else ROW
    rows = keyed(docs.select(F.col(id_col).alias(ident), F.col(text_col).alias("_text")), ident)
    plain = not is_numbered(rows)
    rows = rows.select(*dict.fromkeys([ROW, ident]), normalised("_text").alias("_norm"))
    ids = written(identities(rows.select(ROW, "_norm"), block_bytes), "identities")
    groups = ids.groupBy("_level", "_name").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    marked = ids.join(groups, ["_level", "_name"]).select(ROW, "_first", "group_size")
    if ident != ROW and not plain:
        marked = marked.join(rows.select(F.col(ROW).alias("_first"), F.col("_id").alias("keep_id")), "_first")
    else:
        marked = marked.withColumn("keep_id", F.col("_first"))
    sums = rows.select(*dict.fromkeys([ROW, ident]), F.sha2("_norm", 256).alias("text_sha256"))
    return sums.join(marked, ROW).select(
        F.col(ident).alias(id_col), "keep_id", "group_size", (F.col(ROW) == F.col("_first")).alias("kept"), "text_sha256"
    )

