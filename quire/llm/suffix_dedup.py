"""Removal of repeated byte strings by names that double inside tasks, over a sparse set of positions.

Names are 64-bit: the name of 2h bytes is the pair of the names of h bytes here and h bytes on.
Tasks double their names from 1 to 32 bytes. A window of 100 bytes is represented by the least of its
32-byte names, which neighbouring windows share, so about one position in 35 takes part. Spark deals
these names to hash buckets, where a task sorts them and those that are unique drop out. Windows of the
others are dealt to buckets again, with the name of 100 bytes, the pair of two names of 64, and a task
tells for each name which position is the first. Spark itself sorts and reranks nothing, so this isn't
distributed prefix doubling. Names of equal windows are compared together with their 32-byte names, so
two contents are mistaken for one only if both of two independent 64-bit names agree.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, raw_text, tidy, with_all_texts
from .repeats import chunks, first_windows, merged, planes, release, removals, spans_of, text_bytes, unplanes

TILE = 1 << 17
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)  # names of single bytes
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(32)


def doubled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of pairs."""
    x = a * _A
    x += b * _B
    x ^= x >> _SHIFT
    x *= _B
    return x


def names(flat: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` (a power of two) bytes, along the last axis."""
    x, h = _BYTES[flat], 1
    while h < length:
        x = doubled(x[..., :-h], x[..., h:])
        h *= 2
    return x


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        x = op(x[:-h], x[h:])
        h *= 2
    return op(x[: len(x) - (width - h)], x[width - h :]) if h < width else x


class Scheme:
    """Windows of ``width`` bytes, represented by the least name of ``gram`` bytes within."""

    def __init__(self, width: int):
        self.width = width
        self.gram = 1
        while self.gram * 6 <= width:
            self.gram *= 2
        self.span = width - self.gram + 1  # grams in a window
        self.half = 1
        while self.half * 2 <= width:
            self.half *= 2

    def _tiles(self, texts: list[bytes]):
        """All windows tile by tile: the joined texts, their starts, and each window's text, key and place."""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        number = np.maximum(size - self.width + 1, 0)
        total = int(number.sum())
        before = np.cumsum(number) - number
        for lo in range(0, total, TILE):
            hi = min(lo + TILE, total)
            a, b = np.searchsorted(before, lo, "right") - 1, np.searchsorted(before, hi - 1, "right") - 1
            # texts a to b; only the part of the first and last that the tile needs
            first = start[a] + lo - before[a]
            last = start[b] + hi - 1 - before[b] + self.width
            grams = names(flat[first:last], self.gram)
            least = sliding(grams, self.span, np.minimum)
            owner = np.repeat(np.arange(a, b + 1), np.minimum(before[a : b + 1] + number[a : b + 1], hi) - np.maximum(before[a : b + 1], lo))
            place = np.arange(lo, hi) - before[owner]
            yield flat, start, owner, least[start[owner] + place - first], place, (grams, first)

    def distinct_keys(self, texts: list[bytes]):
        owners, keys = [], []
        for _, start, owner, key, place, (grams, first) in self._tiles(texts):
            # the positions that represent a window: the least gram of one at least
            by_start = np.zeros(len(grams) + self.span - 1, np.uint64)
            by_start[start[owner] + place - first + self.span - 1] = key
            at = np.flatnonzero(sliding(by_start, self.span, np.maximum) == grams)
            owners.append(np.searchsorted(start, at + first, "right") - 1)
            keys.append(grams[at])
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        severals = np.diff(np.r_[np.flatnonzero(first), len(key)]) > 1
        return owner[first], key[first], severals

    def windows(self, texts: list[bytes], key_owner: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        """Runs of neighbouring windows with one shared key, each with the bytes they cover."""
        width, most = self.width, self.span
        known = np.unique(_with_owner(keys, key_owner))
        parts, counts, routes, places, owners = [], [], [], [], []
        for flat, start, owner, key, place, _ in self._tiles(texts):
            tagged = _with_owner(key, owner)
            if not len(known):
                continue
            k = np.minimum(np.searchsorted(known, tagged), len(known) - 1)
            at = np.flatnonzero(known[k] == tagged)
            if not len(at):
                continue
            run = np.r_[True, (at[1:] != at[:-1] + 1) | (tagged[at[1:]] != tagged[at[:-1]])]
            first = np.flatnonzero(run)
            in_run = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            first = np.flatnonzero(in_run % most == 0)  # a longer run (periodic text) is cut
            n = np.diff(np.r_[first, len(at)])
            at = at[first]
            begin = start[owner[at]] + place[at]
            columns = np.arange(width + most - 1)
            index = np.minimum(begin[:, None] + columns, len(flat) - 1)
            parts.append(np.where(columns < (n + width - 1)[:, None], flat[index], 0).astype(np.uint8))
            counts.append(n)
            routes.append(key[at])
            places.append(place[at])
            owners.append(owner[at])
        if not parts:
            e = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), lambda at: b"", (e, e, e)
        part, count, route, place, owner = map(np.concatenate, (parts, counts, routes, places, owners))
        # equal bytes and equal many windows: within the chunk only the first can hold first windows
        pad = np.zeros((len(part), -part.shape[1] % 8), np.uint8)
        code = np.ascontiguousarray(np.concatenate([part, pad], axis=1)).view(np.uint64)
        name = route ^ (count.astype(np.uint64) * _A)
        check = name.copy()
        for column in code.T:
            name, check = doubled(name, column), (check ^ column) * _A
            check ^= check >> np.uint64(29)
        later = first_windows(name, check)
        gone = (owner[later], place[later], place[later] + count[later] + width - 1)
        keep = np.flatnonzero(~later)
        part, count, place, own = part[keep], count[keep].astype(np.uint16), place[keep], rows[owner[keep]]

        def block(at: np.ndarray) -> bytes:
            pieces = [planes(own[at]), planes(place[at]), planes(count[at])]
            lengths = count[at].astype(np.int64) + width - 1
            body = part[at][np.arange(part.shape[1]) < lengths[:, None]].tobytes()
            return np.int64(len(at)).tobytes() + b"".join(pieces) + body

        return route[keep], block, gone

    def settle(self, blocks: list[bytes]):
        """(row, from, to) of the windows whose bytes start earlier."""
        width, most = self.width, self.span
        rows, places, counts, parts = [], [], [], []
        for b in blocks:
            n = int(np.frombuffer(b[:8], np.int64)[0])
            rows.append(unplanes(b[8 : 8 + 8 * n], np.int64))
            places.append(unplanes(b[8 + 8 * n : 8 + 16 * n], np.int64))
            counts.append(unplanes(b[8 + 16 * n : 8 + 18 * n], np.uint16).astype(np.int64))
            part = np.zeros((n, width + most - 1), np.uint8)
            part[np.arange(part.shape[1]) < (counts[-1] + width - 1)[:, None]] = np.frombuffer(b, np.uint8, offset=8 + 18 * n)
            parts.append(part)
        if not rows:
            e = np.zeros(0, np.int64)
            return e, e, e
        row, place, count, part = map(np.concatenate, (rows, places, counts, parts))
        order = np.lexsort((place, row))  # corpus order
        row, place, count = row[order], place[order], count[order]
        full, gram = [], []
        for lo in range(0, len(order), 512):
            x = part[order[lo : lo + 512]]
            mine = np.arange(most) < count[lo : lo + 512, None]
            some = names(x, self.gram)
            check = sliding(some.T, self.span, np.minimum).T  # the key again
            h = self.gram
            while h < self.half:
                some = doubled(some[:, :-h], some[:, h:])
                h *= 2
            rest = width - h
            some = doubled(some[:, : some.shape[1] - rest], some[:, rest:]) if rest else some
            full.append(some[:, :most][mine])
            gram.append(check[:, :most][mine])
        owner = np.repeat(np.arange(len(row)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        later = first_windows(np.concatenate(full), np.concatenate(gram))
        return spans_of(row[owner[later]], (place[owner] + offset)[later], width)


def _with_owner(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key that two texts of a chunk don't share."""
    return key ^ (owner.astype(np.uint64) * _A)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """Removes from each text the bytes covered by a ``width``-byte string that also starts earlier: in a
    document that sorts before by id (nulls last), or in the same one further left.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs), spans (array of from and to,
    in bytes), kept (binary) and kept_sha256; one row per input row. Null texts count as empty. Rows with
    repeated or null ids are documents of their own. Texts shorter than ``width`` stay whole. Strings are
    judged on the input, not on what is left. An empty table gives no rows.
    """
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_id")
    rows = rows.select(ROW, "_id", raw_text("_body").alias("_text"))
    gone = removals(rows, Scheme(width), text_bytes(rows))
    release(docs.sparkSession)
    kind = dict(rows.dtypes)["_id"]

    def apply(batches):
        for _, texts, ids, los, his in chunks(batches):
            out = []
            for text, lo, hi in zip(texts.to_pylist(), los.to_pylist(), his.to_pylist(), strict=True):
                spans = merged(list(zip(lo or [], hi or [], strict=True)))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), [{"lo": a, "hi": b} for a, b in spans], kept, sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], ["i", *"nrskhx"[:6]])

    met = with_all_texts(rows, gone).select(ROW, "_text", "_id", "_from", "_to")
    out = met.mapInArrow(tidy(apply), f"i {kind}, n long, r long, s long, k array<struct<lo:long,hi:long>>, h binary, x string")
    return out.toDF(id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")
