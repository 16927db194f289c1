"""The stages that both repeat-removing operators share.

A window is a fixed number of consecutive items of one document; it goes if its content starts earlier in
the corpus. Each window has a key that its content alone determines, and neighbouring windows mostly
share one. The stages:

1. Every document's distinct keys go to the bucket of the key, where keys of one occurrence drop out.
2. Documents meet their shared keys; windows with a shared key go to the bucket of the key, copies
   within a task being settled before the shuffle. The bucket finds each content's first window.
3. Documents meet the places to remove.

Bytes move in blocks, one row per task and bucket, so that few rows cross the shuffle. The number of
buckets follows the size of the input, so a bucket's memory doesn't grow with it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, partitions, tidy, tidy_group, with_text, written
from .piece_tokenizer import bounded

#: Text bytes per bucket, on average.
BUCKET_BYTES = 8_000_000
CHUNK = 1_500_000


def planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: the planes of small or sorted numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def release(spark) -> None:
    """Drops shuffle files of finished stages that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for the buckets that have keys; places keep their order."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    lo = 0
    for b, hi in enumerate(ends.tolist()):
        if hi > lo:
            yield b, order[lo:hi]
        lo = hi


def lists(rows: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One line for each row with the lists of its values; ``rows`` are sorted."""
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[start, len(rows)].astype(np.int32))
    columns = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64) if v.dtype != np.uint64 else v.view(np.int64))) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(rows[start]), *columns], [ROW, *(f"v{k}" for k in range(len(values)))])


def chunks(batches) -> Iterator[tuple[list, list, list]]:
    """Columns of bounded chunks; the second column has the texts."""
    for batch in batches:
        for lo, hi in bounded(batch.column(1), CHUNK):
            yield tuple(c.slice(lo, hi - lo) for c in batch.columns)


def shared_keys(rows: DataFrame, distinct_keys, buckets: int) -> DataFrame:
    """(row, keys): the keys of each row that occur elsewhere too, or more than once in the row.

    ``distinct_keys(texts)`` gives (number of text, key, whether it has several places) for one chunk.
    """

    def send(batches):
        for ids, texts in chunks(batches):
            owner, keys, several = distinct_keys(texts.to_pylist())
            own = np.asarray(ids)[owner]
            out = [(b, planes(keys[at]), planes(own[at]), np.packbits(several[at]).tobytes()) for b, at in by_bucket(keys, buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["b", "k", "r", "s"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unplanes(x, np.uint64) for x in table["k"].to_pylist()])
        own = np.concatenate([unplanes(x, np.int64) for x in table["r"].to_pylist()])
        sizes = [len(x) // 8 for x in table["k"].to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["s"].to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.argsort(keys)
        k = keys[order]
        same = np.r_[False, k[1:] == k[:-1]]
        at = order[same | np.r_[same[1:], False] | several[order]]
        at = at[np.argsort(own[at], kind="stable")]
        return pa.Table.from_batches([lists(own[at], keys[at])])

    sent = rows.select(ROW, "_text").mapInArrow(tidy(send), "b int, k binary, r binary, s binary")
    met = sent.groupBy("b").applyInArrow(tidy_group(meet), f"{ROW} long, v0 array<long>")
    return met.groupBy(ROW).agg(F.flatten(F.collect_list("v0")).alias("_keys"))


def first_windows(name: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Marks all but the first of equal (name, check) pairs; places are in corpus order."""
    n = len(name)
    if n < 2:
        return np.zeros(n, bool)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    packed = np.sort((name & ~low) | np.arange(n, dtype=np.uint64))  # equal names meet, the earliest first
    at = (packed & low).astype(np.int64)
    group = packed & ~low
    same_group = np.r_[False, group[1:] == group[:-1]]
    equal = np.r_[False, (name[at[1:]] == name[at[:-1]]) & (check[at[1:]] == check[at[:-1]])]
    later = np.zeros(n, bool)
    later[at] = same_group & equal
    if (same_group & ~equal).any():  # different contents met: these groups are settled one by one
        odd = np.isin(group, np.unique(group[same_group & ~equal]))
        places = np.sort(at[odd])
        seen = set()
        for p, x, y in zip(places.tolist(), name[places].tolist(), check[places].tolist(), strict=True):
            later[p] = (x, y) in seen
            seen.add((x, y))
    return later


def spans_of(row: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the places that windows cover, neighbours joined; sorted by row and start."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + width)]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(row) - 1] if len(row) else new
    return row[new], start[new], start[last] + width


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def removals(rows: DataFrame, scheme, total_bytes: int) -> DataFrame:
    """(row, from list, to list) of what goes, in items of the scheme; lists may overlap."""
    spark = rows.sparkSession
    buckets = max(partitions(spark), total_bytes // BUCKET_BYTES + 1)
    shared = written(shared_keys(rows, scheme.distinct_keys, buckets), "shared-keys")
    release(spark)

    def send(batches):
        for ids, texts, keys in chunks(batches):
            order = np.argsort(np.asarray(ids))  # corpus order within the chunk
            own = np.asarray(ids)[order]
            texts, keys = texts.take(pa.array(order)).to_pylist(), keys.take(pa.array(order))
            flat = keys.values.slice(keys.offsets[0].as_py(), keys.offsets[-1].as_py() - keys.offsets[0].as_py())
            key_owner = np.repeat(np.arange(len(own)), np.diff(np.asarray(keys.offsets)))
            route, block, (gone_text, gone_lo, gone_hi) = scheme.windows(texts, key_owner, np.asarray(flat).view(np.uint64), own)
            out = [(b, block(at), b"", b"", b"") for b, at in by_bucket(route, buckets)]
            if len(gone_text):
                out.append((int(own[0] % buckets), None, planes(own[gone_text]), planes(gone_lo.astype(np.int64)), planes(gone_hi.astype(np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], list("bwrlh"))

    def settle(table: pa.Table) -> pa.Table:
        row, lo, hi = scheme.settle([x for x in table["w"].to_pylist() if x is not None])
        parts = [[a] + [unplanes(x, np.int64) for x in table[c].to_pylist() if x] for a, c in ((row, "r"), (lo, "l"), (hi, "h"))]
        row, lo, hi = (np.concatenate(x) for x in parts)
        order = np.argsort(row, kind="stable")
        return pa.Table.from_batches([lists(row[order], lo[order], hi[order])])

    met = with_text(rows.select(ROW, "_text"), shared).select(ROW, "_text", "_keys")
    sent = met.mapInArrow(tidy(send), "b int, w binary, r binary, l binary, h binary")
    found = sent.groupBy("b").applyInArrow(tidy_group(settle), f"{ROW} long, v0 array<long>, v1 array<long>")
    out = found.groupBy(ROW).agg(F.flatten(F.collect_list("v0")).alias("_from"), F.flatten(F.collect_list("v1")).alias("_to"))
    return written(out, "removals")


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("_text"))).first()[0] or 0
