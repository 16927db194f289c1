"""Exact n-gram Jaccard self-join with a token-group matrix.

A document's tokens are its distinct word shingles. Documents with equal sets are one class, and a class
is represented by one row from the start. The stages:

1. Similar documents are partitioned into groups. Sets with one signature of a few drawn tokens in common
   hang together; most near copies do, and a signature costs a row, not pairs. In one order of all tokens,
   those that tasks report as frequent last, a set shows its first tokens: so many that two linked sets
   share at least ``shared_least`` of what they show. Shown tokens meet in Spark, and each set counts those
   it shares with sets that it doesn't hang together with: only where these are enough for a link do
   sets stay. Their shown tokens meet again. Where few sets share one, pairs are
   counted; where many do, only each set's number of such tokens is, and it counts for a pair as if
   they shared them all. Sets that show enough such tokens to be linked by these alone join the
   smallest that shows one. What hangs together, directly or not, is one family. A large family is dealt to blocks twice, by the least token of
   its sets in two orders. The tokens of family members are written once.
2. Each block stores the token union of its groups as a matrix. For a query the overlap with a union
   bounds that with every member; only groups that reach what the threshold asks for are opened, and
   their members' overlaps counted exactly. Members that already hang together aren't compared again.
3. Blocks of one family are joined through a leader of each linked part. What is then still apart is
   searched, as queries, in the blocks of its family whose token union it overlaps enough: a bitmap of
   each block's union bounds that overlap without moving the block.

Only links between different sets that are needed to connect them are made, so a group of thousands of
copies costs no pairs within it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, ROW, keyed, mix, pair, partitions, raw_text, tidy, tidy_group, with_all_texts, with_text, written
from .components import components
from .repeats import BUCKET_BYTES, by_bucket, chunks, planes, release, text_bytes, unplanes

BLOCK = 512
GROUP = 16
LEADERS = 1024
QUERIES = 2048
#: Sharers of one token that are paired with one another. Of larger groups each row is sent once, with the
#: smallest, so that pairs don't grow with the square of a group: at most 3.5 pairs a shown token.
ALL_PAIRS = 8
#: Pairs a task holds at once, about.
PAIRS = 250_000
#: Cells of frequent tokens at most. They only order tokens: any order gives the same links.
CELLS = 1 << 16
CELL_BITS = 22
#: Blocks whose unions a query meets in one task.
UNIONS = 1024
#: Signatures of a set and the tokens drawn for each. Sets of fewer than ``SIGNED`` tokens have none.
SIGNATURES, DRAWS, SIGNED = 6, 4, 32
_DRAWN = np.arange(SIGNATURES * DRAWS, dtype=np.uint64) * np.uint64((1 << 64) // (SIGNATURES * DRAWS))
_TAG = np.uint64(0xC2B2AE3D27D4EB4F)


def token_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words in lower case (A-Z); a text of fewer than
    ``n`` words has one shingle, the whole sequence; without words it has none."""
    parts = [t.lower().split() for t in texts]
    size = [len(p) for p in parts]
    words = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(parts)), np.uint64, sum(size))
    grams = words
    for k in range(1, n):
        grams = pair(grams[:-1], words[k:])
    out, at = [], 0
    for m in size:
        if m >= n:
            x = np.sort(grams[at : at + m - n + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif m:
            x = words[at : at + 1] ^ np.uint64(m)
            for k in range(1, m):
                x = pair(x, words[at + k : at + k + 1])
            out.append(mix(x))
        else:
            out.append(words[:0])
        at += m
    return out


def need(size: int, percent: int) -> int:
    """The overlap that a set of this size has at least with any set it is linked with."""
    return -(-percent * size // 100)


def need_with(size, other, percent: int):
    """The overlap that linked sets of these sizes have at least."""
    return -(-percent * (size + other) // (100 + percent))


def shared_least(size, percent: int):
    """How many of the tokens that they show two linked sets share at least, if this is the smaller's size."""
    return np.minimum(need(size, percent), 1 + size - need(size, percent))


def alone_least(size, percent: int):
    """How many shown tokens a set of this size shares at least with any set it is linked with."""
    return shared_least(need(size, percent), percent)


def shown(sets: list[np.ndarray], percent: int, level: np.ndarray) -> list[np.ndarray]:
    """The tokens each set shows: the first in the order by (level, token).

    Linked sets of sizes s <= t have an overlap of need(t) at least. In any one order of all tokens the first
    s - need(s) + k of one and t - need(t) + k of the other then share k tokens, for k up to need(s).
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = flat[np.argsort(owner << 8 | level[(flat >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")]
    many = sizes - need(sizes, percent) + shared_least(sizes, percent)
    start = np.cumsum(sizes) - sizes
    return [flat[s : s + k] for s, k in zip(start.tolist(), many.tolist(), strict=True)]


def pairs_within(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within runs that begin at ``first`` and are of one ``size`` of at most ``ALL_PAIRS``."""
    left, right = [], []
    for g in np.unique(size).tolist():
        a, b = np.triu_indices(g, 1)
        start = first[size == g]
        left.append((start[:, None] + a).ravel())
        right.append((start[:, None] + b).ravel())
    e = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (e, e)


class Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)


def link_block(sets: list[np.ndarray], percent: int, parts: Parts, queries: list[int] | None = None, group: int = GROUP) -> list[tuple[int, int]]:
    """Links (positions) that connect all linked sets of a block that ``parts`` has apart.

    ``queries``: positions to search for, all by default.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    if not len(flat):
        return []
    known, ids = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    order = sorted((i for i in range(m) if sizes[i]), key=lambda i: (own[i][0], sizes[i]))  # similar sets often have one least token
    groups = [order[k : k + group] for k in range(0, len(order), group)]
    union = np.zeros((len(groups), len(known)), bool)  # the token-group matrix
    for g, members in enumerate(groups):
        for i in members:
            union[g, own[i]] = True
    largest = np.array([max(sizes[i] for i in g) for g in groups])
    smallest = np.array([min(sizes[i] for i in g) for g in groups])
    mark, links = np.zeros(len(known), bool), []
    for q in order if queries is None else [q for q in queries if sizes[q]]:
        n = int(sizes[q])
        least = need_with(n, np.maximum(smallest, need(n, percent)), percent)
        bound = union[:, own[q]].sum(axis=1)
        may = np.flatnonzero((bound >= least) & (100 * largest >= percent * n) & (percent * smallest <= 100 * n))
        if not len(may):
            continue
        mark[own[q]] = True
        for g in may.tolist():
            for i in groups[g]:
                if parts.find(i) == parts.find(q) or 100 * min(n, sizes[i]) < percent * max(n, sizes[i]):
                    continue
                shared = int(mark[own[i]].sum())
                if 100 * shared >= percent * (n + int(sizes[i]) - shared):
                    parts.join(i, q)
                    links.append((q, i))
        mark[own[q]] = False
    return links


def merged_pairs(pairs: np.ndarray, counts: np.ndarray, least: np.ndarray):
    """Each pair (smaller, larger) once, with its summed count and the greatest of the other numbers."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, counts, least = pairs[order], counts[order], least[order]
    if not len(pairs):
        return pairs, counts, least
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
    return pairs[first], np.add.reduceat(counts, first), np.maximum.reduceat(least, first)


def signatures(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The signatures of each set: names of ``DRAWS`` tokens, each the first from a fixed number on, going round.

    Two sets draw the same token with the probability of their similarity. Any signatures give the same links.
    """
    large = [x for x in sets if len(x) >= SIGNED]
    if not large:
        return [np.zeros(0, np.uint64)] * len(sets)
    drawn = np.stack([x[np.searchsorted(x, _DRAWN) % len(x)] for x in large]).reshape(-1, SIGNATURES, DRAWS)
    name = drawn[:, :, 0]
    for k in range(1, DRAWS):
        name = pair(name, drawn[:, :, k])
    names = iter(name)
    return [next(names) if len(x) >= SIGNED else name[0, :0] for x in sets]


def _first_of_equal(sets: list[np.ndarray]) -> np.ndarray:
    """Marks the first of equal sets."""
    seen: set = set()
    code = [(len(x), int(mix(x).sum())) for x in sets]
    return np.array([not (c in seen or seen.add(c)) for c in code], bool)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def _describe(rows: DataFrame, n: int) -> DataFrame:
    """(row, size, two hashes of the set, signatures), and a line without row for each task: the cells of tokens
    that stand out among its sets, and how often they occur."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    line = lambda *columns: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [ROW, "n", "f", "g", "signs", "cells", "times"])

    def run(batches):
        times, seen = np.zeros(1 << CELL_BITS, np.int32), set()
        for ids, texts in chunks(batches):
            sets = token_sets(texts.to_pylist(), n)
            f = np.zeros((len(sets), 2), np.uint64)
            for i, x in enumerate(sets):
                if len(x):
                    f[i] = mix(x).sum(), np.bitwise_xor.reduce(mix(x * _TAG))
            new = [x for x, c in zip(sets, f[:, 0].tolist(), strict=True) if not (c in seen or seen.add(c))]
            times += np.bincount(_cells(np.concatenate([np.zeros(0, np.uint64), *new])), minlength=len(times)).astype(np.int32)
            yield line(ids, [len(x) for x in sets], *(c.view(np.int64) for c in np.ascontiguousarray(f.T)), [x.view(np.int64) for x in signatures(sets)], *[[None] * len(sets)] * 2)
        mean = times.mean()
        often = np.flatnonzero(times >= max(4, len(seen) // 2048, mean + 6 * mean**0.5))
        yield line([None], [0], [0], [0], [None], [planes(often.astype(np.uint32))], [planes(times[often])])

    return rows.select(ROW, "_text").mapInArrow(tidy(run), f"{ROW} long, n long, f long, g long, signs array<long>, cells binary, times binary")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cell, level) of the at most ``CELLS`` most frequent cells; level grows with the logarithm of the count."""

    def spread(batches):
        for batch in batches:
            for cells, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unplanes(cells, np.uint32).astype(np.int64)), pa.array(unplanes(times, np.int32).astype(np.int64))], ["cell", "n"])

    lines = sets.where(F.length("cells") > 0).select("cells", "times").mapInArrow(spread, "cell long, n long")
    often = lines.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > ALL_PAIRS // 2)
    top = often.orderBy(F.desc("n"), "cell").limit(CELLS).toArrow()
    return top["cell"].to_numpy(), np.minimum(255, 1 + 6 * np.log2(np.maximum(top["n"].to_numpy(), 1))).astype(np.uint8)


def _alike(sets: DataFrame, member: DataFrame) -> DataFrame:
    """(v, label): the representatives that hang together by their signatures, and the smallest of each part."""
    reps = sets.where(F.size("signs") > 0).select(ROW, "signs").join(member.where(F.col("rep") == F.col(ROW)).select(ROW), ROW)
    signs = written(reps.select(ROW, F.explode("signs").alias("sign")), "signatures")
    first = signs.groupBy("sign").agg(F.min(ROW).alias("a"), F.max(ROW).alias("last")).where("a < last").select("sign", "a")
    return components(signs.join(first, "sign").select("a", F.col(ROW).alias("b")).where("a <> b"))


def _sharing(rows: DataFrame, n: int, percent: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row): those of ``rows`` (row, text, part) that can be linked with a row of another part.

    Linked rows show ``alone_least`` tokens in common at least. A row counts the tokens it shows that a row of
    another part shows too. Where a chunk sees both, it counts by itself and sends only two rows of different
    parts, so that a very frequent token costs two rows a chunk. Counts move in blocks to the bucket of the row.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)  # at most CELLS numbers

    def several(token: np.ndarray, part: np.ndarray):
        """An order by token and part, the first and the last place of each place's token in it, and whether their parts differ."""
        order = np.lexsort((part, token))
        token, part = token[order], part[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(token)])
        last = first + times - 1
        return order, first, last, np.repeat(part[first] != part[last], times)

    def counted(row: np.ndarray, count: np.ndarray, least: np.ndarray) -> list[tuple]:
        return [(c, *(planes(np.ascontiguousarray(v[x])) for v in (row, count, least))) for c, x in by_bucket(mix(row.view(np.uint64)), buckets)]

    def send(batches):
        level = np.zeros(1 << CELL_BITS, np.uint8)
        level[shared.value[0]] = shared.value[1]
        for ids, texts, parts in chunks(batches):
            own, part, sets = np.asarray(ids), np.asarray(parts), token_sets(texts.to_pylist(), n)
            first_tokens = shown(sets, percent, level)
            token, place = np.concatenate([np.zeros(0, np.uint64), *first_tokens]), np.repeat(np.arange(len(own)), [len(x) for x in first_tokens])
            order, first, last, both = several(token, part[place])
            token, place = token[order], place[order]
            go = ~both
            go[first] = go[last] = True
            some = np.fromiter(map(len, sets), np.int64, len(sets))
            has = some > 0
            counts = np.bincount(place[~go], minlength=len(own))
            out = [(int(own[0] % buckets), *[None] * 3, *line) for line in counted(own[has], counts[has], alone_least(some, percent)[has])]
            token, place = token[go], place[go]
            out += [(b, planes(token[x]), planes(own[place[x]]), planes(part[place[x]]), *[None] * 4) for b, x in by_bucket(token, buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3), strict=True)], list("bspqcrkl"))

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, kind=np.int64: np.concatenate([np.zeros(0, kind), *(unplanes(x, kind) for x in table[c].to_pylist() if x)])
        token, row = read("s", np.uint64), read("p")
        order, _, _, both = several(token, read("q"))
        row, count = np.unique(row[order][both], return_counts=True)
        own = counted(row, count, np.zeros(len(row), np.int64))
        own = pa.table([pa.array(x, t) for x, t in zip(zip(*own, strict=True) if own else [[]] * 4, (pa.int32(), *[pa.binary()] * 3), strict=True)], list("crkl"))
        return pa.concat_tables([own, table.select(list("crkl")).filter(table["c"].is_valid()).cast(own.schema)])

    def settle(table: pa.Table) -> pa.Table:
        row, count, least = (np.concatenate([np.zeros(0, np.int64), *(unplanes(x, np.int64) for x in table[c].to_pylist())]) for c in "rkl")
        row, place = np.unique(row, return_inverse=True)
        return pa.table({ROW: row[np.bincount(place, count, len(row)) >= np.bincount(place, least, len(row))]})

    sent = rows.select(ROW, "_text", "part").mapInArrow(tidy(send), "b int, s binary, p binary, q binary, c int, r binary, k binary, l binary")
    counts = sent.groupBy("b").applyInArrow(tidy_group(meet), "c int, r binary, k binary, l binary")
    return written(counts.groupBy("c").applyInArrow(tidy_group(settle), f"{ROW} long"), "sharing")


def _families(rows: DataFrame, n: int, percent: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): pairs of rows that connect all rows that may be linked.

    A token that more than ``ALL_PAIRS`` sets show is hot. Let ``h`` be a row's number of hot tokens. Linked
    rows share ``least`` shown tokens, of which at most the smaller ``h`` are hot, so the others are at least
    ``least - h``: such pairs are found by counting. If that leaves none, both rows have an ``h`` of
    ``least`` or more and show a hot token in common, where each meets its smallest row. A chunk sends
    only one row for a token that is hot in it, where its own hot tokens already decide that for a row.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)  # at most CELLS numbers

    def send(batches):
        level = np.zeros(1 << CELL_BITS, np.uint8)
        level[shared.value[0]] = shared.value[1]
        for ids, texts in chunks(batches):
            order = np.argsort(np.asarray(ids))
            own, sets = np.asarray(ids)[order], token_sets(texts.take(pa.array(order)).to_pylist(), n)
            once = _first_of_equal(sets)  # it speaks for all
            own, sets = own[once], [x for x, new in zip(sets, once.tolist(), strict=True) if new]
            first_tokens = shown(sets, percent, level)
            sizes = [len(x) for x in first_tokens]
            token, place = np.concatenate(first_tokens), np.repeat(np.arange(len(own)), sizes)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            _, inverse, times = np.unique(token, return_inverse=True, return_counts=True)
            hot = times[inverse] > ALL_PAIRS
            decided = np.bincount(place[hot], minlength=len(own)) >= alone_least(size, percent)
            at = np.flatnonzero(hot & decided[place])
            kinds, first, which = np.unique(inverse[at], return_index=True, return_inverse=True)
            hub = place[at][first][which]  # rows ascend, so the first is the smallest
            hung = hub != place[at]
            pairs, counts, _ = merged_pairs(np.stack([own[hub[hung]], own[place[at[hung]]]], axis=1), np.ones(hung.sum(), np.int64), place[at[hung]])
            lows = alone_least(size, percent)[np.searchsorted(own, pairs[:, 1])]
            keep = np.ones(len(token), bool)
            keep[at[hung]] = False
            go = np.flatnonzero(keep)
            token, row, size, hot = token[go], own[place[go]], size[place[go]].astype(np.int32), hot[go].astype(np.uint8)
            out = [(b, planes(token[x]), planes(row[x]), planes(size[x]), planes(hot[x]), *[b""] * 4) for b, x in by_bucket(token, buckets)]
            if len(pairs):
                out.append((int(own[0] % buckets), *[None] * 4, *(planes(np.ascontiguousarray(x)) for x in (pairs[:, 0], pairs[:, 1], counts, lows))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 8), strict=True)], list("bsrnfxykl"))

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, kind=np.int64: np.concatenate([np.zeros(0, kind), *(unplanes(x, kind) for x in table[c].to_pylist() if x)])
        hot_pairs, cold = [(np.stack([read("x"), read("y")], axis=1), read("k"), read("l"))], []
        token, row, size, marked_hot = read("s", np.uint64), read("r"), read("n", np.int32).astype(np.int64), read("f", np.uint8)
        order = np.lexsort((row, token))
        token, row, size, marked_hot = token[order], row[order], size[order], marked_hot[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(token)])
        if len(first):
            hot = (times > ALL_PAIRS) | (np.maximum.reduceat(marked_hot, first) > 0)
            big = np.flatnonzero(np.repeat(hot, times))
            hub = np.repeat(row[first], times)[big]
            hot_pairs.append((np.stack([hub, row[big]], axis=1), np.ones(len(big), np.int64), alone_least(size[big], percent)))
            some = np.flatnonzero((times > 1) & ~hot)
            many = np.cumsum(times[some] * (times[some] - 1) // 2)
            for lo, hi in zip(cuts := [0, *np.searchsorted(many, np.arange(PAIRS, int(many[-1]) if len(many) else 0, PAIRS)).tolist(), len(some)], cuts[1:], strict=False):
                if hi > lo:
                    a, b = pairs_within(first[some[lo:hi]], times[some[lo:hi]])
                    small = np.minimum(size[a], size[b])
                    ok = 100 * small >= percent * np.maximum(size[a], size[b])
                    a, b, small = a[ok], b[ok], small[ok]
                    cold.append(merged_pairs(np.stack([row[a], row[b]], axis=1), np.ones(len(a), np.int64), shared_least(small, percent)))
        out = []
        for parts, is_hot in ((hot_pairs, True), (cold, False)):
            if parts:
                pairs, counts, least = merged_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                out.append(pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "k": counts, "least": least, "hot": np.full(len(pairs), is_hot)}))
        return pa.concat_tables(out)

    kinds = "b int, s binary, r binary, n binary, f binary, x binary, y binary, k binary, l binary"
    sent = rows.select(ROW, "_text").mapInArrow(tidy(send), kinds)
    met = sent.groupBy("b").applyInArrow(tidy_group(meet), "a long, b long, k long, least long, hot boolean")
    found = written(met.groupBy("a", "b", "hot").agg(F.sum("k").alias("k"), F.max("least").alias("least")).where("a <> b or hot"), "met")
    cold, hot = found.where("not hot"), found.where("hot")
    h = written(hot.groupBy("b").agg(F.sum("k").alias("h"), F.max("least").alias("low")), "hot")
    out = cold.where("k >= least").select("a", "b")
    out = out.unionByName(hot.where("a <> b").select("a", "b").join(h.where("h >= low").select("b"), "b").select("a", "b"))
    less = cold.where("k < least").join(h.select("b", "h"), "b").where("k + h >= least")
    less = less.join(h.select(F.col("b").alias("a"), F.col("h").alias("g")), "a").where("k + g >= least")
    return out.unionByName(less.select("a", "b"))


def _tokens(rows: DataFrame, n: int) -> DataFrame:
    """(row, label, m, tokens, least token, least token in another order) of ``rows`` (row, text, label, m)."""

    def run(batches):
        for ids, texts, labels, m in chunks(batches):
            sets = token_sets(texts.to_pylist(), n)
            low = [[int(y[0] >> np.uint64(2)) for y in (x, np.sort(mix(x * _TAG))[:1])] if len(x) else [0, 0] for x in sets]
            yield pa.RecordBatch.from_arrays([ids, labels, m, pa.array([planes(x) for x in sets], pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*low, strict=True))], [ROW, "label", "m", "tokens", "low", "other"])

    return rows.select(ROW, "_text", "label", "m").mapInArrow(tidy(run), f"{ROW} long, label long, m long, tokens binary, low long, other long")


def _bin(column, bins: int):
    return F.pmod(F.xxhash64(column), F.lit(bins))


def _runs(table: pa.Table, key: str):
    """(lo, hi) of the runs of equal ``key`` in a sorted table."""
    block = np.asarray(table[key].combine_chunks())
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return zip(first.tolist(), np.r_[first[1:], len(block)].tolist(), strict=True)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the linked sets within each block, or of queries with the block's members.
    ``rows``: (row, tokens, block, query, bin)."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), (ROW, "ascending")])
        row, query = (np.asarray(table[c].combine_chunks() if c != "query" else table[c].cast(pa.int8()).combine_chunks()) for c in (ROW, "query"))
        a, b = [], []
        for lo, hi in _runs(table, "block"):
            asked = np.flatnonzero(query[lo:hi]).tolist()
            sets = [unplanes(x, np.uint64) for x in table["tokens"].slice(lo, hi - lo).to_pylist()]
            found = link_block(sets, percent, Parts(hi - lo), asked or None)
            a += [row[lo + x] for x, _ in found]
            b += [row[lo + y] for _, y in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select(ROW, "tokens", "block", "query", "bin").groupBy("bin").applyInArrow(tidy_group(settle), "a long, b long")


def union_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of the union of some sets, of a byte a token or more."""
    bits = 1 << max(6, (8 * sum(map(len, sets)) - 1).bit_length())
    out = np.zeros(bits, bool)
    for x in sets:
        out[(x & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


def may_link(tokens: np.ndarray, union: np.ndarray, smallest: int, largest: int, percent: int) -> bool:
    """Whether a set can be linked with a set of a block, given the bitmap of its union and its sizes."""
    n = len(tokens)
    if 100 * largest < percent * n or percent * smallest > 100 * n:
        return False
    at = tokens & np.uint64(8 * len(union) - 1)
    hits = (union[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
    return int(hits.sum()) >= need_with(n, max(smallest, need(n, percent)), percent)


def _unions(rows: DataFrame) -> DataFrame:
    """(label, block, union, smallest, largest) of ``rows`` (label, block, bin, tokens)."""

    def unite(table: pa.Table) -> pa.Table:
        table, out = table.sort_by("block"), []
        for lo, hi in _runs(table, "block"):
            sets = [unplanes(x, np.uint64) for x in table["tokens"].slice(lo, hi - lo).to_pylist()]
            sizes = [len(x) for x in sets]
            out.append((table["label"][lo].as_py(), table["block"][lo].as_py(), union_bits(sets).tobytes(), min(sizes), max(sizes)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["label", "block", "tokens", "smallest", "largest"])

    return rows.select("label", "block", "bin", "tokens").groupBy("bin").applyInArrow(tidy_group(unite), "label long, block long, tokens binary, smallest long, largest long")


def _searches(asked: DataFrame, unions: DataFrame, percent: int, bins: int) -> DataFrame:
    """(row, block): the blocks of its family where each row of ``asked`` (row, label, tokens) must be searched."""

    def bound(table: pa.Table) -> pa.Table:
        table, rows, blocks = table.sort_by([("meeting", "ascending"), (ROW, "ascending")]), [], []
        for lo, hi in _runs(table, "meeting"):
            lines = table.slice(lo, hi - lo).to_pylist()
            unions = [(x["block"], np.frombuffer(x["tokens"], np.uint8), x["smallest"], x["largest"]) for x in lines if x["block"] is not None]
            for x in lines:
                if x["block"] is None:
                    tokens = unplanes(x["tokens"], np.uint64)
                    found = [block for block, *facts in unions if may_link(tokens, *facts, percent)]
                    rows += [x[ROW]] * len(found)
                    blocks += found
        return pa.table({ROW: pa.array(rows, pa.int64()), "block": pa.array(blocks, pa.int64())})

    cuts = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("cuts"))
    sizes = cuts.join(unions.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / UNIONS).alias("slices")), "label")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("_n")
    none = F.lit(None).cast("long")
    ask = asked.join(sizes, "label").select(ROW, "label", "tokens", F.pmod(F.xxhash64(ROW), "cuts").alias("cut"), every("slices"))
    ask = ask.select(ROW, "tokens", F.xxhash64("label", "cut", "_n").alias("meeting"), none.alias("block"), none.alias("smallest"), none.alias("largest"))
    offer = unions.join(sizes, "label").withColumn("slice", F.pmod(F.xxhash64("block"), "slices")).select("*", every("cuts"))
    offer = offer.select(none.alias(ROW), "tokens", F.xxhash64("label", "_n", "slice").alias("meeting"), "block", "smallest", "largest")
    met = ask.unionByName(offer).withColumn("bin", _bin("meeting", bins))
    return met.groupBy("bin").applyInArrow(tidy_group(bound), f"{ROW} long, block long")


def linked(reps: DataFrame, member: DataFrame, sets: DataFrame, n: int, percent: int, total_bytes: int) -> DataFrame | None:
    """(v, label) for the representatives that are linked with others; None if there are none.

    ``reps``: all rows with their text, of which those of the table ``member`` (row, rep) that represent a
    class are asked for. ``sets``: what ``_describe`` gives.
    """
    spark = reps.sparkSession
    buckets = max(partitions(spark), total_bytes // BUCKET_BYTES + 1)
    frequent, alike = _frequent(sets), _alike(sets, member)
    # copies, which their representative speaks for, and what hangs together already
    marks = member.join(alike.select(F.col("v").alias("rep"), F.col("label").alias("part")), "rep", "left").select(ROW, "rep", "part")
    marks = written(marks.where(f"rep <> {ROW} or part is not null"), "marks")
    own = with_all_texts(reps.select(ROW, "_text"), marks).where(f"rep is null or rep = {ROW}").select(ROW, "_text", F.coalesce("part", ROW).alias("part"))
    sharing = _sharing(own, n, percent, buckets, frequent)
    release(spark)
    tokens, left = sets.where(F.col(ROW).isNotNull()).select(ROW, "n").join(sharing.withColumn("stays", F.lit(1)), ROW, "left").agg(F.sum("n"), F.sum(F.col("n") * F.col("stays"))).first()
    fewer = max(partitions(spark), -(-buckets * (left or 0) // max(tokens or 0, 1)))
    pairs = _families(with_text(reps.select(ROW, "_text"), sharing), n, percent, fewer, frequent)
    pairs = written(pairs.unionByName(alike.select(F.col("label").alias("a"), F.col("v").alias("b"))).where("a <> b").distinct(), "family-pairs")
    release(spark)
    if pairs.isEmpty():
        return None
    family = components(pairs)
    sizes = family.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    family = written(family.join(sizes, "label").withColumnRenamed("v", ROW), "families")
    tokens = written(_tokens(with_text(reps, family), n), "family-tokens")
    release(spark)

    def dealt(rows: DataFrame, low: str) -> DataFrame:
        """(row, label, block): large families by the least token of their sets, and again where many share it."""
        parts = F.when(F.col("m") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("m") / (BLOCK // 2)))
        rows = rows.select(ROW, "label", F.pmod(F.xxhash64(low), parts).alias("part"), F.lit(low).alias("by"))
        full = rows.groupBy("label", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
        return rows.join(full, ["label", "part"]).select(ROW, "label", F.xxhash64("by", "label", "part", F.pmod(F.xxhash64(ROW), "cuts")).alias("block"))

    blocks = written(dealt(tokens, "low"), "blocks")
    large = tokens.where(F.col("m") > BLOCK)
    both = blocks.select(ROW, "block").unionByName(dealt(large, "other").select(ROW, "block"))
    links = written(_links(_placed(tokens, both, buckets), percent), "links")
    release(spark)
    if not large.isEmpty():
        links = _across(tokens, blocks.join(large.select(ROW), ROW), links, percent, buckets)
    return None if links.isEmpty() else components(links)


def _placed(tokens: DataFrame, places: DataFrame, bins: int) -> DataFrame:
    """The tokens of each place (row, block, maybe query), with the bin of its block."""
    places = places if "query" in places.columns else places.withColumn("query", F.lit(False))
    return tokens.select(ROW, "tokens").join(places, ROW).withColumn("bin", _bin("block", bins))


def _across(tokens: DataFrame, big: DataFrame, links: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``links`` and those between blocks of one large family."""
    big = written(big, "large-families")

    def labelled(links):
        parts = components(links.unionByName(big.select(F.col(ROW).alias("a"), F.col(ROW).alias("b"))))
        return written(big.join(parts.select(F.col("v").alias(ROW), F.col("label").alias("at")), ROW), "parts")

    now = labelled(links)
    leaders = now.where(F.col(ROW) == F.col("at"))
    counts = leaders.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / LEADERS).alias("cuts"))
    leaders = leaders.join(counts, "label").select(ROW, F.xxhash64("label", F.pmod(F.xxhash64(ROW), "cuts")).alias("block"))
    links = written(links.unionByName(_links(_placed(tokens, written(leaders, "leaders"), buckets), percent)), "links")
    now = labelled(links)
    # the largest part of each family needs no search; what is apart from it does
    sizes = now.groupBy("label", "at").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("label").agg(F.max(F.struct("k", "at")).getField("at").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = written(now.join(main, "label"), "apart")
    if apart.isEmpty():
        return links
    asked = apart.where("at <> main").select(ROW, "label")
    unions = written(_unions(tokens.select(ROW, "tokens").join(apart.select(ROW, "label", "block"), ROW).withColumn("bin", _bin("block", buckets))), "unions")
    found = written(_searches(tokens.select(ROW, "tokens").join(asked, ROW), unions, percent, buckets), "searches")
    cuts = found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("cuts"))
    to = found.join(cuts, "block").select(ROW, "block", F.pmod(F.xxhash64(ROW), "cuts").alias("part"), F.lit(True).alias("query"))
    members = apart.select(ROW, "block").join(cuts, "block").select(ROW, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("part"), F.lit(False).alias("query"))
    every = to.unionByName(members).groupBy(ROW, "block", "part").agg(F.max("query").alias("query"))
    every = written(every.select(ROW, F.xxhash64("block", "part").alias("block"), "query"), "meetings")
    return written(links.unionByName(_links(_placed(tokens, every, 4 * buckets), percent)), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``id_col``, n_shingles, class_id (smallest id with the very same set) and component_id
    (smallest id reachable by links, its own included); one row per input row. Null texts and texts without
    words have no shingles and no links. Rows with repeated or null ids are documents of their own;
    where null ids are linked with others, these sort first. An empty table gives no rows.
    """
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_id")
    rows = rows.select(ROW, "_id", raw_text("_body").alias("_text"))
    sets = written(_describe(rows, shingle), "sets")
    described = sets.where(F.col(ROW).isNotNull()).select(ROW, "n", "f", "g")
    classes = described.groupBy("n", "f", "g").agg(F.min(ROW).alias("rep")).where("n > 0")
    member = written(described.join(classes, ["n", "f", "g"], "left").select(ROW, "n", F.coalesce("rep", ROW).alias("rep")), "classes")
    found = linked(rows.select(ROW, "_text"), member.select(ROW, "rep"), sets, shingle, percent, text_bytes(rows))
    if found is not None:
        member = member.join(found.select(F.col("v").alias("rep"), "label"), "rep", "left")
    else:
        member = member.withColumn("label", F.lit(None).cast("long"))
    member = member.select(ROW, "n", "rep", F.coalesce("label", "rep").alias("label"))
    ids = rows.select(ROW, "_id")
    out = ids.join(member, ROW)
    for column in ("rep", "label"):
        out = out.join(ids.select(F.col(ROW).alias(column), F.col("_id").alias(f"{column}_id")), column)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep_id").alias("class_id"), F.col("label_id").alias("component_id"))
