"""Streams: search over arriving pages, results in page order, and the latest of several requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..limits import MATCHES_PER_DOCUMENT
from ..operators.search import Options, page_matches

PAGES = "doc_id long, page_index int, text string"


def arriving_pages(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 100) -> DataFrame:
    """Pages from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_search(pages: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """Matches of each page as it arrives; stateless, so append mode needs no watermark."""
    each = page_matches(pages, query, options).select("doc_id", "page_index", F.posexplode("hits").alias("match_no", "h"))
    return each.select("doc_id", "page_index", "match_no", "h.lo", "h.hi", "h.snippet")


def in_page_order(pages: DataFrame, query: str, options: Options = Options(), most: int = MATCHES_PER_DOCUMENT) -> DataFrame:
    """(doc_id, page_index, n, before) of each document's pages in order, however they arrive: a page waits
    until all before it have come. After ``most`` matches a document gives no more. Pages without matches
    count too; a page that comes again is ignored."""
    found = page_matches(pages, query, options).select("doc_id", "page_index", F.size("hits").alias("n"))
    none = pages.select("doc_id", "page_index", F.lit(0).alias("n"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, total, waiting = state.get if state.exists else (0, 0, "")
        held = {int(k): int(v) for k, v in (x.split(":") for x in waiting.split(",") if x)}
        for frame in frames:
            for page, n in zip(frame["page_index"], frame["n"], strict=True):
                if page >= following:
                    held[int(page)] = max(held.get(int(page), 0), int(n))
        out = []
        while following in held:
            n = min(held.pop(following), most - total)
            if n:
                out.append((key[0], following, n, total))
            following, total = following + 1, total + n
        state.update((following, total, ",".join(f"{k}:{v}" for k, v in held.items())))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "page_index", "n", "before"])

    both = found.unionByName(none)
    return both.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id long, page_index int, n int, before int", "following int, total int, waiting string", "append", GroupStateTimeout.NoTimeout
    )


def latest(requests: DataFrame, session: str, seq: str) -> DataFrame:
    """The last request of each session; earlier ones are dropped, also when they come late (complete or
    update mode)."""
    rest = [c for c in requests.columns if c != session]
    out = requests.groupBy(session).agg(F.max_by(F.struct(*rest), seq).alias("_v"))
    return out.select(session, *(F.col(f"_v.{c}").alias(c) for c in rest))
