"""Helpers shared by the operators: row keys, written intermediate tables, tokens and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of the white space that separates words, the same set that ``bytes.split()`` uses.
SPACES = r"[\x20\x09-\x0D]+"
ROW = "_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, the context's checkpoint folder, or on one machine a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a lost executor costs
    no recomputation of what stands above. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with a unique, non-null long ``_row`` that orders rows as ``id_col`` does (nulls last).

    Ids that are unique and not null serve as they are; a column-only aggregation decides that. Otherwise
    rows are sorted by id and numbered, and the numbered table is written once, so that every later
    reading sees the same numbers. Repeated ids are thus separate documents; their mutual order is that
    of the text, and of equal rows arbitrary but fixed.
    """
    docs = docs.select(*dict.fromkeys([id_col, *columns])) if columns is not None else docs
    docs = docs.drop(ROW) if id_col != ROW else docs
    kind = dict(docs.dtypes)[id_col]
    n, some, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if n == some == distinct and kind in ("tinyint", "smallint", "int", "bigint"):
        return docs if id_col == ROW else docs.withColumn(ROW, F.col(id_col).cast("long"))
    if id_col == ROW:
        raise ValueError("_row must be unique and not null")
    order = [F.col(id_col).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c, t in docs.dtypes if c != id_col and not t.startswith(("map", "array<map", "variant")))]
    out = written(docs.orderBy(*order).withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    out._quire_numbered = True
    return out


def is_numbered(rows: DataFrame) -> bool:
    """Whether ``keyed`` had to number these rows; if not, ``_row`` equals the id."""
    return getattr(rows, "_quire_numbered", False)


#: Bits of a row filter at most: 8 MB, whatever the number of rows.
FILTER_BITS = 1 << 26


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: true for all rows of ``ids`` and few others, to thin out texts before a shuffle.

    It is a bitmap of at most ``FILTER_BITS``, broadcast in parts of 4 KB: beyond some millions of rows it
    lets more and more through, and a join decides in any case.
    """
    n, bits = ids.count(), 1 << 15
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    place = F.pmod(F.xxhash64(ROW), F.lit(bits))
    parts = ids.select(place.alias("_h")).groupBy((F.col("_h") / 32768).cast("int").alias("_part")).agg(F.bitmap_construct_agg(F.col("_h") % 32768).alias("_bits"))
    out = rows.withColumn("_h", place).withColumn("_part", (F.col("_h") / 32768).cast("int"))
    out = out.join(F.broadcast(parts), "_part", "left")  # FILTER_BITS / 32768 rows at most
    at = (F.col("_h") % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at % 8)) != 0
    return out.withColumn("_may", F.coalesce(bit, F.lit(False))).drop("_h", "_part", "_bits")


def with_text(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` joined with ``ids`` by ``_row``; texts of other rows stay where they are."""
    return marked(rows, ids).where("_may").drop("_may").join(ids, ROW)


def with_all_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All ``rows``, with the columns of ``ids`` or null; only texts that may meet a row of ``ids`` are shuffled."""
    own = marked(rows, ids)
    out, rest = own.where("_may").drop("_may").join(ids, ROW, "left"), own.where("not _may").drop("_may")
    for c, t in ids.dtypes:
        rest = rest if c == ROW else rest.withColumn(c, F.lit(None).cast(t))
    return out.unionByName(rest)


def raw_text(name: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


class WordHash(dict):
    """Maps a word (bytes) to a 64-bit hash and remembers at most ``limit`` of them."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for each worker process.
HASHES = WordHash()


def trim() -> None:
    """Gives this process's freed memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``; when a task ends, its worker gives freed memory back. What functions of other
    modules have learnt in that worker goes first."""
    module = run.__module__

    def tidied(batches):
        owned(module)
        yield from run(batches)
        trim()

    return tidied


def tidy_group(run):
    """The same for the function of ``applyInArrow``, after each group."""
    module = run.__module__

    def tidied(table):
        owned(module)
        out = run(table)
        trim()
        return out

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each ordered pair."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo:
    """What a worker process has learnt about words, kept from task to task in two generations.

    ``now`` holds every word of the batch at hand. Once it is over ``limit`` it becomes the old
    generation, from which words in use return; the rest is forgotten.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def prepare(self, words: set, learn) -> dict:
        """A dict that holds all ``words``; ``learn(list)`` gives a dict of those that are new."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        missing = [w for w in words if w not in now]
        if old:
            now.update((w, old[w]) for w in missing if w in old)
            missing = [w for w in missing if w not in old]
        if missing:
            now.update(learn(missing))
        return now


_MEMOS: dict = {}


def worker_memo(key, limit: int) -> Memo:
    """This worker process's memo for ``key``; a new key replaces the memos of others, and the hashes of words."""
    if key not in _MEMOS:
        _MEMOS.clear()
        HASHES.clear()
        trim()
        _MEMOS[key] = Memo(limit)
    return _MEMOS[key]


_MADE: dict = {}


def worker_made(kind: str, source, make):
    """What ``make(source)`` gives, kept for this worker process; one object of each kind."""
    key = hash(source)
    if _MADE.get(kind, (None,))[0] != key:
        _MADE[kind] = (key, make(source))
    return _MADE[kind][1]


_OWNER = [""]


def owned(module: str) -> None:
    """Memos and made objects of this worker process are from now on those of functions of ``module``. Workers live on
    from one operator to the next, so that in a pipeline each would else hold what an earlier one knew."""
    if _OWNER[0] != module:
        _OWNER[0] = module
        if _MEMOS or _MADE:
            _MEMOS.clear()
            _MADE.clear()
            trim()
