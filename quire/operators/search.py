"""Search over page texts, and what readers do with its matches.

``pages`` always means a DataFrame with doc_id, page_index and text (null: the page has no text).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..limits import MATCHES_PER_DOCUMENT, MATCHES_PER_PAGE, SNIPPET_REACH
from ..shared import pieces


@dataclass(frozen=True)
class Options:
    """What counts as different; by default neither case nor diacritics do."""

    case_sensitive: bool = False
    diacritic_sensitive: bool = False


_RANGE = [("lo", pa.int64()), ("hi", pa.int64())]
_SNIPPET = [("snippet", pa.string()), ("snip_lo", pa.int32()), ("snip_hi", pa.int32())]


def page_matches(pages: DataFrame, query: str, options: Options = Options(), per_page: int | None = MATCHES_PER_PAGE, snippets: bool = True) -> DataFrame:
    """(doc_id, page_index, hits): the pages with matches, in original UTF-16 coordinates. One pass without
    a shuffle; pages that cannot match are dropped before any Python runs. Texts with characters that only
    Python folds as the query is folded all pass."""
    asked = T.fold(T.trimmed(query), options.case_sensitive, options.diacritic_sensitive)
    flags = (options.case_sensitive, options.diacritic_sensitive)
    keys = pages.select("doc_id", "page_index", "text")
    if not asked:
        may = keys.where(F.lit(False))
    else:
        may = keys.where(T.folded(F.col("text"), *flags).contains(asked) | T.undecided(F.col("text")))
    kinds, fields = dict(keys.dtypes), _RANGE + _SNIPPET * snippets
    names, hits_type = [n for n, _ in fields], pa.list_(pa.struct(fields))

    def run(batches):
        for batch in pieces(batches):
            own, sizes = [], []
            for text in batch.column(2).to_pylist():
                found = T.find_matches(text, asked, *flags, per_page)
                if snippets:
                    found = [(lo, hi, *T.snippet(text, lo, hi, SNIPPET_REACH)) for lo, hi in found]
                sizes.append(len(found))
                own += found
            columns = zip(*own, strict=True) if own else [[]] * len(fields)
            parts = [pa.array(x, t) for x, (_, t) in zip(columns, fields, strict=True)]
            offsets = pa.array([0, *accumulate(sizes)], pa.int32())
            hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names)).cast(hits_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hits], ["doc_id", "page_index", "hits"])

    hit = "array<struct<lo:bigint,hi:bigint" + ",snippet:string,snip_lo:int,snip_hi:int" * snippets + ">>"
    found = may.mapInArrow(run, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, hits {hit}")
    return found.where(F.size("hits") > 0)


def search(pages: DataFrame, query: str, options: Options = Options(), per_page: int = MATCHES_PER_PAGE, per_document: int = MATCHES_PER_DOCUMENT, snippets: bool = True) -> DataFrame:
    """All matches by page, then position: at most ``per_page`` of a page and ``per_document`` of a document.

    The document's cap is a running sum over its pages' counts, for which its pages' matches are sorted together;
    without ``snippets`` they are ranges only.
    """
    found = page_matches(pages, query, options, per_page, snippets)
    before = F.sum(F.size("hits")).over(W.partitionBy("doc_id").orderBy("page_index").rowsBetween(W.unboundedPreceding, -1))
    capped = found.withColumn("_left", F.lit(per_document) - F.coalesce(before, F.lit(0))).where("_left > 0")
    capped = capped.withColumn("hits", F.slice("hits", F.lit(1), F.greatest(F.col("_left"), F.lit(1)).cast("int")))
    each = capped.select("doc_id", "page_index", F.posexplode("hits").alias("match_no", "h"))
    return each.select("doc_id", "page_index", "match_no", *(F.col(f"h.{n}").alias(n) for n, _ in _RANGE + _SNIPPET * snippets))


def count_matches(pages: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """(doc_id, page_index, n) without caps: by string functions, and texts that these don't fold as the query
    is folded by ``page_matches``."""
    asked = T.fold(T.trimmed(query), options.case_sensitive, options.diacritic_sensitive)
    if not asked:
        return pages.where(F.lit(False)).select("doc_id", "page_index", F.lit(0).cast("bigint").alias("n"))
    text = T.folded(F.col("text"), options.case_sensitive, options.diacritic_sensitive)
    n = ((F.length(text) - F.length(F.replace(text, F.lit(asked), F.lit("")))) / len(asked)).cast("bigint")
    odd = F.coalesce(T.undecided(F.col("text")), F.lit(False))
    plain = pages.where(~odd).select("doc_id", "page_index", n.alias("n")).where("n > 0")
    rest = page_matches(pages.where(odd), query, options, None, snippets=False)
    return plain.unionByName(rest.select("doc_id", "page_index", F.size("hits").cast("bigint").alias("n")))


def provided(provider: DataFrame, own: DataFrame) -> DataFrame:
    """Page texts from a provider, and the document's own where the provider has none."""
    own = own.select("doc_id", "page_index", F.col("text").alias("_own"))
    both = provider.select("doc_id", "page_index", "text").join(own, ["doc_id", "page_index"], "full_outer")
    return both.select("doc_id", "page_index", F.coalesce("text", "_own").alias("text"))


def flat_index(matches: DataFrame) -> DataFrame:
    """Matches with their number within the document, by page and position; the first is selected."""
    order = W.partitionBy("doc_id").orderBy("page_index", "lo")
    return matches.withColumn("flat", F.row_number().over(order) - 1).withColumn("selected", F.col("flat") == 0)


def advance(cursor, delta, count):
    """The match a step from ``cursor`` leads to, around the ends; null without matches."""
    return F.when(count > 0, F.pmod(cursor + delta, count))


def by_page(matches: DataFrame) -> DataFrame:
    """One row per page with its number of matches and their ranges in order."""
    ranges = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    return matches.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"), ranges.alias("ranges"))
