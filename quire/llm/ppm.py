"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is lower-cased (A-Z) and read as one byte stream: each word followed by a space, and one more space at
the end; before it stand ``ORDER`` spaces, which are contexts only. The context of a byte is the ``ORDER``
bytes before it, whatever words they belong to. A byte unknown in its longest context escapes to the next
shorter one (escape estimate C), where the bytes that the longer context knew are excluded.

The trie holds every (context, byte) of the training texts, so it grows with them; it is never in one place:

1. One pass counts pairs of neighbouring bytes of the training texts: orders 0 and 1, 65,536 counts at most.
2. Texts are dealt to chunks by a hash. A chunk sends each of its distinct strings of ``ORDER`` + 1 bytes once,
   with its number of training occurrences, to the bucket of the last two bytes of its context, and each
   of its distinct words to a bucket of words.
3. A bucket has all occurrences of its contexts of order 2 and more, so it builds its part of the trie, and
   answers each chunk with the code length of each string, or the training count of each word.
4. Chunks meet the answers and add them up for each text.

The unigram baseline takes the counts of words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, mix, partitions, raw_text, tidy, tidy_group, trim, written
from .piece_tokenizer import bounded
from .repeats import by_bucket, planes, text_bytes, unplanes

ORDER = 6
#: Bits of a place in a slice.
PLACE_BITS = 23
#: Text bytes a chunk holds on average, and bytes of its stream that are taken at once.
CHUNK = 4_000_000
SLICE = 1 << PLACE_BITS
#: Buckets of contexts at most: the last two bytes of a context take few values.
CONTEXTS = 4096
SPACE = 32
#: The chunk under which buckets report their number of known words.
REPORT = -1


@dataclass
class Trie:
    """Entries sorted by key, and for each context its totals and those of its suffix without its own bytes."""

    keys: list[np.ndarray]  # by order
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    total_rest: list[np.ndarray]
    distinct_rest: list[np.ndarray]

    @classmethod
    def of(cls, key: np.ndarray, order: np.ndarray, count: np.ndarray) -> Trie:
        out = cls([], [], [], [], [], [], [])
        for k in range(ORDER + 1):
            own = order == k
            by = np.argsort(key[own])
            keys, counts = key[own][by], count[own][by].astype(np.float64)
            contexts, start, distinct = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, start) if len(start) else counts
            rest_t, rest_q = np.zeros(len(contexts)), np.zeros(len(contexts))
            if k and len(contexts):
                mask = (1 << (8 * (k - 1))) - 1
                parent = np.searchsorted(out.contexts[-1], (contexts & mask) | ((k - 1) << (8 * (k - 1))))
                shorter = (keys & ((1 << (8 * k)) - 1)) | ((k - 1) << (8 * k))
                shared = out.counts[-1][np.searchsorted(out.keys[-1], shorter)]
                rest_t = out.total[-1][parent] - np.add.reduceat(shared, start)
                rest_q = out.distinct[-1][parent] - distinct
            for to, x in zip((out.keys, out.counts, out.contexts, out.total, out.distinct, out.total_rest, out.distinct_rest), (keys, counts, contexts, total, distinct, rest_t, rest_q), strict=True):
                to.append(x)
        return out

    def scores(self, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the ``depth`` bytes before it."""
        at = code
        logp = np.zeros(len(at))
        # of the suffix that is next: totals without the bytes of the longer context; -1 before the first known one
        rest_t, rest_q = np.full(len(at), -1.0), np.full(len(at), -1.0)
        open_ = np.ones(len(at), bool)
        for k in range(ORDER, -1, -1):
            go = np.flatnonzero(open_ & (depth >= k))
            if not len(go) or not len(self.keys[k]):
                continue
            key = code[go] & ((1 << (8 * (k + 1))) - 1) | (k << (8 * (k + 1)))
            c = np.minimum(np.searchsorted(self.contexts[k], key >> 8), len(self.contexts[k]) - 1)
            there = self.contexts[k][c] == key >> 8
            go, key, c = go[there], key[there], c[there]
            if not len(go):
                continue
            first = rest_q[go] < 0
            t = np.where(first, self.total[k][c], rest_t[go])
            q = np.where(first, self.distinct[k][c], rest_q[go])
            e = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][e] == key
            logp[go[hit]] += np.log10(self.counts[k][e[hit]] / (t[hit] + q[hit]))
            open_[go[hit]] = False
            miss = ~hit & (q > 0)
            logp[go[miss]] += np.log10(q[miss] / (t[miss] + q[miss]))
            rest_t[go[~hit]], rest_q[go[~hit]] = self.total_rest[k][c[~hit]], self.distinct_rest[k][c[~hit]]
        known = len(self.keys[0])
        logp[open_] -= np.log10(max(1, 256 - known))  # none is open where all are known
        return logp


def stream(words: list[bytes]) -> bytes:
    """The stream of a text of these words, with the spaces before it."""
    return b" " * ORDER + b" ".join(words) + (b"  " if words else b" ")


def codes(flat: np.ndarray) -> np.ndarray:
    """For each byte after the first ``ORDER``: the bytes before it and the byte, in the lower 56 bits."""
    padded = flat.tobytes() + b"\0"
    eight = np.ndarray((len(flat) - ORDER,), ">u8", padded, 0, (1,))  # at every byte the eight from there
    out = eight.astype(np.int64)
    out >>= 8
    out &= (1 << 56) - 1
    return out


def gathered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places so ordered that equal codes stand together, the code of each group, and each place's group. Places
    are sorted together with a hash of their code, so now and then one code may have several groups."""
    key = mix(code.view(np.uint64))
    key &= np.uint64(~((1 << PLACE_BITS) - 1) & (1 << 64) - 1)
    key |= np.arange(len(code), dtype=np.uint64)
    key.sort()
    key &= np.uint64((1 << PLACE_BITS) - 1)
    place = key.astype(np.int32)
    ordered = code[place]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    return place, ordered[new], np.cumsum(new, dtype=np.int32) - 1


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(planes(x), 1)


def unpacked(b: bytes, kind) -> np.ndarray:
    return unplanes(zstandard.decompress(b), kind)


def slices(parts: list[list[bytes]]):
    """(codes, text number) of all bytes of the texts' streams, ``SLICE`` at once."""
    flat = b"".join(map(stream, parts))
    size = np.fromiter((len(b"".join(p)) + len(p) + 1 for p in parts), np.int64, len(parts)) + ORDER
    flat, end = np.frombuffer(flat, np.uint8), np.cumsum(size)
    for lo in range(ORDER, len(flat), SLICE):
        hi = min(lo + SLICE, len(flat))
        a, b = np.searchsorted(end, [lo, hi - 1], "right")
        owner = np.repeat(np.arange(a, b + 1, dtype=np.int32), np.minimum(end[a : b + 1], hi) - np.maximum(end[a : b + 1] - size[a : b + 1], lo))
        own = np.ones(hi - lo, bool)  # but for the spaces before a text
        start = end[a : b + 1] - size[a : b + 1]
        places = (start[:, None] + np.arange(ORDER)).ravel() - lo
        own[places[(places >= 0) & (places < hi - lo)]] = False
        yield codes(flat[lo - ORDER : hi])[own], owner[own]


def _contexts(code: np.ndarray, buckets: int):
    """(bucket, places) by the last two bytes of the contexts."""
    return by_bucket(mix((code.view(np.uint64) >> np.uint64(8)) & np.uint64(0xFFFF)), buckets)


def _by_word(words: list[bytes], buckets: int):
    return by_bucket(mix(np.fromiter(map(crc32, words), np.uint64, len(words))), buckets)


def _ordered(table: pa.Table) -> tuple[pa.Table, list[list[bytes]]]:
    """A chunk's rows in order, and their words."""
    table = table.sort_by(ROW)
    return table, [t.lower().split() for t in table["_text"].to_pylist()]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def byte_pairs(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The counts of all pairs of neighbouring bytes in the streams of ``rows`` (row, text), 256 x 256, and the
    number of their tokens."""

    def run(batches):
        pairs, tokens = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for lo, hi in bounded(batch.column(1), 2_000_000):
                parts = [t.lower().split() for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                tokens += sum(map(len, parts)) + len(parts)
                for code, _ in slices(parts):
                    pairs += np.bincount(code & 0xFFFF, minlength=1 << 16)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[pairs[some], tokens])], ["pair", "n"])

    found = rows.select(ROW, "_text").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(1 << 16, np.int64)
    out[pair[pair >= 0]] = n[pair >= 0]
    return out.reshape(256, 256), int(n[pair < 0].sum())


def part_of_trie(code: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> Trie:
    """The trie of some contexts: codes with their training counts, and the pairs of bytes of all texts."""
    key, order, n = [], [], []
    for k, own in ((0, pairs.sum(axis=0)), (1, pairs.ravel())):
        some = np.flatnonzero(own)
        key.append(some | k << (8 * (k + 1)))
        order.append(np.full(len(some), k))
        n.append(own[some])
    code, count = code[count > 0], count[count > 0]
    for k in range(2, ORDER + 1):
        some, place = np.unique(code & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        key.append(some | k << (8 * (k + 1)))
        order.append(np.full(len(some), k))
        n.append(np.bincount(place, count, len(some)))
    return Trie.of(np.concatenate(key), np.concatenate(order), np.concatenate(n))


_ASKED = "bucket int, chunk long, part int, body binary, counts binary"
_ANSWER = "chunk long, part int, bucket int, counts binary"


def _asker(contexts: int, buckets: int):
    """What a chunk asks: of part -1 its words, of the other parts its strings of bytes."""

    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        table, parts = _ordered(table)
        training, out = np.asarray(table["_train"].cast(pa.int8()).combine_chunks()), []
        for k, (code, owner) in enumerate(slices(parts)):
            code <<= 1
            code |= training[owner]  # whether it is for training
            code.sort()
            first = np.flatnonzero(np.r_[True, code[1:] >> 1 != code[:-1] >> 1])
            n = np.add.reduceat(code & 1, first).astype(np.uint32)
            code = code[first] >> 1
            out += [(b, chunk, k, packed(code[at]), packed(n[at])) for b, at in _contexts(code, contexts)]
        known = Counter(chain.from_iterable(p for p, t in zip(parts, training.tolist(), strict=True) if t))
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        n = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        out += [(contexts + b, chunk, -1, zstandard.compress(b" ".join([words[i] for i in at.tolist()]), 1), packed(n[at])) for b, at in _by_word(words, buckets)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)] if out else [[]] * 5, ["bucket", "chunk", "part", "body", "counts"])

    return ask


def _answerer(contexts: int, pairs: np.ndarray):
    """What a bucket answers: code lengths of strings as 32-bit floats, or counts of words."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        chunk, part, bodies, counts = (table[c].to_pylist() for c in ("chunk", "part", "body", "counts"))
        counts = [unpacked(x, np.uint32) for x in counts]
        if bucket < contexts:
            code = np.concatenate([unpacked(x, np.int64) for x in bodies])
            code, place = np.unique(code, return_inverse=True)
            trie = part_of_trie(code, np.bincount(place, np.concatenate(counts), len(code)), pairs)
            value = trie.scores(code, np.full(len(code), ORDER)).astype(np.float32)[place]
            ends = np.cumsum([len(x) for x in counts]).tolist()
            answers = [packed(value[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
        else:
            total: dict[bytes, int] = {}
            bodies = [zstandard.decompress(x).split(b" ") for x in bodies]
            for words, n in zip(bodies, counts, strict=True):
                for w, m in zip(words, n.tolist(), strict=True):
                    if m:
                        total[w] = total.get(w, 0) + m
            answers = [packed(np.fromiter((total.get(w, 0) for w in words), np.int64, len(words))) for words in bodies]
            chunk, part, answers = [*chunk, REPORT], [*part, -1], [*answers, packed(np.array([len(total)]))]
        return pa.table([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array([bucket] * len(chunk), pa.int32()), pa.array(answers, pa.binary())], ["chunk", "part", "bucket", "counts"])

    return answer


def _adder(contexts: int, buckets: int):
    """Adds up the answers for each text of a chunk: tokens, known ones, the sum of log10(c + 0.1), the score
    and the number of ends of training texts among all. The report's line has no row."""
    names = [ROW, "t", "k", "b", "s"]

    def add(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = {(p, b): x for p, b, x in zip(answers["part"].to_pylist(), answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True)}
        if not len(table):  # the report
            types = sum(int(unpacked(x, np.int64)[0]) for x in found.values())
            return pa.table([pa.array([x], t) for x, t in zip((None, types, 0, 0.0, 0.0), (*[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)], names)
        table, parts = _ordered(table)
        score = np.zeros(len(parts))
        for k, (code, owner) in enumerate(slices(parts)):
            place, code, group = gathered(code)
            order = np.argsort(code)  # the question's
            known = code[order]
            new = np.r_[True, known[1:] != known[:-1]]
            answer = np.empty(np.count_nonzero(new), np.float32)
            for b, at in _contexts(known[new], contexts):
                answer[at] = unpacked(found.pop((k, b)), np.float32)
            value = np.empty(len(code), np.float32)
            value[order] = answer[np.cumsum(new) - 1]
            score += np.bincount(owner[place], value[group], len(parts))
        del value, answer, order, place, code, group, known, owner
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        count = np.zeros(len(words), np.int64)
        for b, at in _by_word(words, buckets):
            count[at] = unpacked(found[-1, contexts + b], np.int64)
        number, term = dict(zip(words, range(len(words)), strict=True)), np.log10(count + 0.1)
        base, known = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
        for i, p in enumerate(parts):
            own = np.fromiter(map(number.__getitem__, p), np.int64, len(p))
            base[i], known[i] = term[own].sum(), np.count_nonzero(count[own])
        return pa.table([table[ROW], pa.array([len(p) + 1 for p in parts], pa.int64()), pa.array(known), pa.array(base), pa.array(score)], names)

    return add


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Scores all texts of ``docs`` with what those rows teach for which ``training`` is true (null: not).

    Returns ``id_col``, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's
    probability), one row per input row. An empty or null text is one end token. Repeated rows and null ids
    are scored each; an empty table gives no rows; without training texts every byte has probability 1/256.
    Only the columns named and those of ``training`` are read.
    """
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"), F.coalesce(training, F.lit(False)).alias("_train")), "_id")
    rows = rows.select(ROW, "_id", raw_text("_body").alias("_text"), "_train")
    pairs, tokens = byte_pairs(rows.where("_train"))
    ends = int(rows.where("_train").count())
    total = text_bytes(rows)
    chunks, buckets = total // chunk + 1, max(partitions(docs.sparkSession), total // CHUNK + 1)
    contexts = min(buckets, CONTEXTS)
    dealt = rows.select(F.pmod(F.xxhash64(ROW), F.lit(chunks)).alias("chunk"), ROW, "_text", "_train")
    asked = dealt.groupBy("chunk").applyInArrow(tidy_group(_asker(contexts, buckets)), _ASKED)
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(_answerer(contexts, pairs)), _ANSWER)
    add = _adder(contexts, buckets)

    def added(table, more):
        out = add(table, more)
        trim()
        return out

    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(added, f"{ROW} long, t long, k long, b double, s double")
    scored = written(scored, "scores")
    types = scored.where(F.col(ROW).isNull()).agg(F.sum("t")).first()[0] or 0
    size = tokens + 0.1 * (types + (ends > 0) + 1)
    end = float(np.log10(ends + 0.1))
    out = scored.where(F.col(ROW).isNotNull()).join(rows.select(ROW, "_id"), ROW)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("t").alias("n_tokens"),
        (F.col("k") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("b") + F.lit(end) - F.col("t") * F.lit(float(np.log10(size)))).alias("base_score"),
        F.col("s").alias("score"),
    )
