"""What a cache with a cost budget keeps, replayed from its log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recent:
    """Keys with costs, the least recently used first; what costs more than the budget is never kept."""

    def __init__(self, budget: int):
        self.budget, self.total, self.costs = budget, 0, OrderedDict()

    def access(self, key, cost: int) -> tuple[bool, int]:
        """Whether the key was there, and how many others left for it."""
        if key in self.costs:
            self.costs.move_to_end(key)
            return True, 0
        gone = 0
        if cost <= self.budget:
            while self.total + cost > self.budget and self.costs:
                self.total -= self.costs.popitem(last=False)[1]
                gone += 1
            self.costs[key] = cost
            self.total += cost
        return False, gone


def replay(log: DataFrame, budget: int) -> DataFrame:
    """(cache, seq, key, hit, evicted, total) for a log (cache, seq, key, cost) of accesses, each a look-up followed by
    an insertion if it misses.

    The order of one cache's log is its result, so a cache stays in one task; there it is read in batches, and only
    what the budget holds is in memory. Caches are dealt over the partitions.
    """
    kinds = dict(log.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            rows, total = [], []
            for cache, key, cost in zip(*(batch[c].to_pylist() for c in ("cache", "key", "cost")), strict=True):
                if held is None or cache != now:
                    now, held = cache, Recent(budget)
                rows.append(held.access(key, cost))
                total.append(held.total)
            hits, gone = zip(*rows, strict=True) if rows else ((), ())
            columns = [batch["cache"], batch["seq"], batch["key"], pa.array(hits, pa.bool_()), pa.array(gone, pa.int32()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["cache", "seq", "key", "hit", "evicted", "total"])

    dealt = log.select("cache", "seq", "key", F.col("cost").cast("bigint").alias("cost")).repartition("cache").sortWithinPartitions("cache", "seq")
    return dealt.mapInArrow(run, f"cache {kinds['cache']}, seq {kinds['seq']}, key {kinds['key']}, hit boolean, evicted int, total bigint")
