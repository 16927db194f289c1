"""Removal of repeated word windows, found by the first rounds of recompression.

Each document's words are names, and ``ROUNDS`` rounds inside tasks replace runs of one name and then pairs of neighbours by new
names. Whether two neighbours become a pair follows from one bit of each name, so equal stretches of text
get equal symbols wherever they stand, except near their ends. A name is a 64-bit hash of what it
replaces, which makes names global without an exchange. For each symbol the rounds also carry the range
of words that its shape depends on. A window is represented by one symbol whose whole range lies inside
it, the least by a hash of that range; a window without one (long runs) represents itself. Spark brings
equal representatives of all documents together; those that occur once drop out, and for the rest the
windows around them are compared by a 64-bit name and 32 bits of a second hash of all their words, not by
the words themselves, to find the first place.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, ROW, keyed, mix, pair, raw_text, tidy, with_all_texts
from .repeats import chunks, first_windows, merged, planes, release, removals, spans_of, text_bytes, unplanes

ROUNDS = 2
FAR = np.int64(1 << 60)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TAG = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def compress(names: np.ndarray, doc: np.ndarray, rounds: int):
    """(start, end, from, to) of each symbol after some rounds: the words it covers, and the words that
    decide on it. Next to a document's ends, what decides lies outside: ``from`` or ``to`` is far away."""
    start = np.arange(len(names))
    end, lo, hi = start + 1, start.copy(), start + 1
    for r in range(rounds):
        for step in ("runs", "pairs"):
            n = len(names)
            if not n:
                break
            joined = doc[1:] == doc[:-1]
            before = np.r_[-FAR, np.where(joined, lo[:-1], -FAR)]  # what the left neighbour depends on
            after = np.r_[np.where(joined, hi[1:], FAR), FAR]
            if step == "runs":
                first = np.flatnonzero(np.r_[True, ~(joined & (names[1:] == names[:-1]))])
                last = np.r_[first[1:], n] - 1
                count = (last - first + 1).astype(np.uint64)
                names = np.where(count > 1, pair(names[first], count), names[first])
                lo, hi = before[first], after[last]
            else:
                right = (mix(names ^ np.uint64(r + 1)) & np.uint64(1)).astype(bool)
                two = np.r_[joined & ~right[:-1] & right[1:], False]
                second = np.r_[False, two[:-1]]
                lo, hi = np.where(right & ~second, before, lo), np.where(~right & ~two, after, hi)
                names = np.where(two, pair(names, np.r_[names[1:], np.uint64(0)]), names)
                first = np.flatnonzero(~second)
                last = first + two[first]
                names, lo, hi = names[first], lo[first], hi[last]
            start, end, doc = start[first], end[last], doc[first]
    return start, end, lo, hi, doc


class Scheme:
    """Windows of ``width`` words."""

    def __init__(self, width: int, rounds: int = ROUNDS):
        self.width, self.rounds = width, rounds

    def _windows(self, texts: list[bytes]):
        """Owner, place, key, name and check of all windows, and the tagged keys of all symbols."""
        parts, width = [t.split() for t in texts], self.width
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        n = int(size.sum())
        words = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(parts)), np.uint64, n)
        begin = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(parts)), size)
        number = np.maximum(size - width + 1, 0)
        owner = np.repeat(np.arange(len(parts)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        at = begin[owner] + place
        if not len(at):
            e = np.zeros(0, np.uint64)
            return owner, place, e, e, e, e
        sums = np.r_[np.uint64(0), np.cumsum(words * powers(_BASE, n), dtype=np.uint64)]
        back = powers(_BACK, n + 1)

        def stretch(lo, hi):
            """A hash of the words from lo to hi."""
            return mix((sums[hi] - sums[lo]) * back[lo] ^ (hi - lo).astype(np.uint64))

        check = stretch(at, at + width)
        h, name = 1, words
        while h * 2 <= width:
            name, h = pair(name[:-h], name[h:]), h * 2
        name = (pair(name[: len(name) - (width - h)], name[width - h :]) if h < width else name)[at]
        _, _, lo, hi, own = compress(words, doc, self.rounds)
        inside = (lo >= 0) & (hi <= n) & (hi - lo <= width)
        lo, hi, own = lo[inside], hi[inside], own[inside]
        value = stretch(lo, hi)
        tagged = value ^ own.astype(np.uint64) * _TAG
        # symbols from a to b lie inside the window
        a = np.r_[0, np.cumsum(np.bincount(lo, minlength=n))][at]
        b = np.r_[0, np.cumsum(np.bincount(hi, minlength=n + 1))][np.minimum(at + width + 1, n + 1)]
        key = name.copy()
        found = np.flatnonzero(b > a)
        a, b = a[found], b[found]
        level = np.log2(b - a).astype(np.int64)
        table = value
        for k in range(int(level.max(initial=0)) + 1):
            mine = np.flatnonzero(level == k)
            key[found[mine]] = np.minimum(table[a[mine]], table[b[mine] - (1 << k)])
            table = np.minimum(table[: max(0, len(table) - (1 << k))], table[1 << k :])
        own_key = np.ones(len(key), bool)
        own_key[found] = False
        tagged = np.concatenate([tagged, (key ^ owner.astype(np.uint64) * _TAG)[own_key]])
        return owner, place, key, name, check, np.sort(tagged)

    def distinct_keys(self, texts: list[bytes]):
        owner, _, key, _, _, tagged = self._windows(texts)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, np.int64)
        owner, key = owner[new], key[new]
        code, first = np.unique(key ^ owner.astype(np.uint64) * _TAG, return_index=True)
        several = np.searchsorted(tagged, code, "right") - np.searchsorted(tagged, code, "left") > 1
        return owner[first], key[first], several

    def windows(self, texts: list[bytes], key_owner: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        owner, place, key, name, check, _ = self._windows(texts)
        known = np.unique(keys ^ key_owner.astype(np.uint64) * _TAG)
        at = np.flatnonzero(np.isin(key ^ owner.astype(np.uint64) * _TAG, known))
        owner, place, key, name, check = owner[at], place[at], key[at], name[at], check[at]
        later = first_windows(name, check)
        gone = spans_of(owner[later], place[later], self.width)
        keep = np.flatnonzero(~later)
        own, place, name = rows[owner[keep]], place[keep], name[keep]
        check = (check[keep] >> np.uint64(32)).astype(np.uint32)

        def block(at: np.ndarray) -> bytes:
            return np.int64(len(at)).tobytes() + planes(own[at]) + planes(place[at]) + planes(name[at]) + planes(check[at])

        return key[keep], block, gone

    def settle(self, blocks: list[bytes]):
        parts = []
        for b in blocks:
            n = int(np.frombuffer(b[:8], np.int64)[0])
            cuts = [8 + n * x for x in (0, 8, 16, 24, 28)]
            kinds = (np.int64, np.int64, np.uint64, np.uint32)
            parts.append([unplanes(b[p:q], kind) for p, q, kind in zip(cuts, cuts[1:], kinds, strict=False)])
        if not parts:
            e = np.zeros(0, np.int64)
            return e, e, e
        row, place, name, check = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, row))  # corpus order
        later = order[first_windows(name[order], check[order].astype(np.uint64))]
        return spans_of(row[later], place[later], self.width)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Removes from each text the words covered by a window of ``width`` words that also starts earlier: in
    a document that sorts before by id (nulls last), or in the same one further left.

    Returns ``id_col``, n_words, n_removed, spans (array of from and to, in words), kept (the kept words
    joined by one space) and kept_sha256; one row per input row. Words are the stretches without ASCII
    white space, unchanged. Null texts have none. Rows with repeated or null ids are documents of their
    own. Texts of fewer words stay whole. Windows are judged on the input. An empty table gives no rows.
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
                words = text.split()
                spans = merged(list(zip(lo or [], hi or [], strict=True)))
                at, kept = 0, []
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                body = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), [{"lo": a, "hi": b} for a, b in spans], str(body, "utf-8", "replace"), sha256(body).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], list("inrskx"))

    met = with_all_texts(rows, gone).select(ROW, "_text", "_id", "_from", "_to")
    out = met.mapInArrow(tidy(apply), f"i {kind}, n long, r long, s array<struct<lo:long,hi:long>>, k string, x string")
    return out.toDF(id_col, "n_words", "n_removed", "spans", "kept", "kept_sha256")
