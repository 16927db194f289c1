"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where a space follows another character: no piece of such a vocabulary reaches over that
place, so segments are independent and each distinct one is encoded once per task. New segments of a
batch are laid flat in one symbol array. Each round takes the minimum pair rank of every segment, merges
its leftmost occurrences at once (up to the first merge that creates a better pair, so the result is that
of one merge at a time), compacts the array and drops finished segments, until no pair remains.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, tidy, worker_made, worker_memo

SPACE = "▁"
#: Pairs at or beyond this rank are runs of spaces, all of one score: the leftmost goes first.
TIED = 1_000_000_000
NONE = np.int64(2**62)


class PieceModel:
    """Piece tables of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        kinds = [p.type for p in proto.pieces]
        self.names = [p.piece for p in proto.pieces]
        self.size = len(self.names)
        self.digits = [b"%d" % i for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.names) if kinds[i] == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that reach over a space are not supported")
        self.known: dict[tuple[int, int], int] = {}
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []  # what decoding gives for each id
        for i, p in enumerate(self.names):
            if kinds[i] == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            elif kinds[i] == 2:
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(b"" if kinds[i] == 3 else p.replace(SPACE, " ").encode())
        self.chars = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        #: Neighbours within pieces: no merge reaches over any other pair of characters.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        keys, made = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.ranks = np.array([round(-p.score) for p in proto.pieces], np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the id of the piece that each pair makes. Negative symbols never pair."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        made = np.where(ok, self.made[at], -1)
        return np.where(ok, self.ranks[made], NONE), made

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as little-endian 32-bit integers. """
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        s, seg = self.chars[points], np.repeat(np.arange(len(segments)), lens)
        if (s < 0).any():  # bytes of unknown characters; they never merge
            raw = [chr(c).encode("utf-8", "replace") if new else b"x" for c, new in zip(points.tolist(), (s < 0).tolist(), strict=True)]
            wide = np.fromiter(map(len, raw), np.int64, len(raw))
            unknown, s, seg = np.repeat(s < 0, wide), np.repeat(s, wide), np.repeat(seg, wide)
            s[unknown] = -1 - np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(raw), np.uint8)[unknown]]
        out: list[bytes] = [b""] * len(segments)

        def finish(s: np.ndarray, seg: np.ndarray) -> None:
            if len(s):
                flat = np.where(s < 0, -1 - s, s).astype("<i4").tobytes()
                start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                for k, a, b in zip(seg[start].tolist(), (start * 4).tolist(), (np.r_[start[1:], len(s)] * 4).tolist(), strict=True):
                    out[k] = flat[a:b]

        def ranks(s, seg):
            r, m = np.full(len(s), NONE), np.full(len(s), -1, np.int64)
            if len(s) > 1:
                r[:-1], m[:-1] = self.pairs(s[:-1], s[1:])
                r[:-1][seg[1:] != seg[:-1]] = NONE
            return r, m

        rank, made = ranks(s, seg)
        while len(s):
            start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[start, len(s)])
            least = np.minimum.reduceat(rank, start)
            live = least < TIED
            if not live.all():  # finished, but for runs of spaces
                over = np.repeat(~live, size)
                for k in np.flatnonzero((least >= TIED) & (least < NONE)).tolist():
                    a, b = start[k], start[k] + size[k]
                    row, ids = s[a:b].tolist(), seg[a]
                    out_row = self._leftmost(row)
                    out[ids] = np.array([-1 - x if x < 0 else x for x in out_row], "<i4").tobytes()
                plain = np.repeat(least >= NONE, size)
                finish(s[plain], seg[plain])
                s, seg, rank, made = s[~over], seg[~over], rank[~over], made[~over]
                if not len(s):
                    break
                size, least = size[live], least[live]
                start = np.cumsum(size) - size
            best = np.repeat(least, size)
            hit = rank == best
            at = np.flatnonzero(hit)
            # of overlapping occurrences (x x x) every second one, from the left
            linked = np.r_[False, at[1:] == at[:-1] + 1]
            run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            new, r, owner = made[at], best[at], seg[at]
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(s) - 1)
            before = np.where((at > 0) & (seg[left] == owner), s[left], -1)
            touching = np.r_[False, (at[1:] == at[:-1] + 2) & (owner[1:] == owner[:-1])]
            before = np.where(touching, np.r_[-1, new[:-1]], before)
            after = np.where((at + 2 < len(s)) & (seg[right] == owner), s[right], -1)
            bad = (self.pairs(before, new)[0] < r) | (self.pairs(new, after)[0] < r)
            # after a merge that makes a better pair, its segment waits for the next round
            seen = np.cumsum(bad) - bad
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            base = np.repeat(seen[first], np.diff(np.r_[first, len(at)]))
            at = at[seen == base]
            s[at] = made[at]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            now = moved[at]
            s, seg, rank, made = s[keep], seg[keep], rank[keep], made[keep]
            for place in (now, now[now > 0] - 1):  # the pairs that changed
                nxt = np.minimum(place + 1, len(s) - 1)
                r2, m2 = self.pairs(s[place], s[nxt])
                same = (place + 1 < len(s)) & (seg[nxt] == seg[place])
                rank[place], made[place] = np.where(same, r2, NONE), np.where(same, m2, -1)
        return out

    def _leftmost(self, row: list[int]) -> list[int]:
        """Merges pairs of equal rank, the leftmost first: a stack in which no neighbours can merge."""
        done: list[int] = []
        for x in row:
            while done and (y := self._pair(done[-1], x)) >= 0:
                done.pop()
                x = y
            done.append(x)
        return done

    def _pair(self, a: int, b: int) -> int:
        if (a, b) not in self.known:
            self.known[a, b] = int(self.pairs(np.array([a]), np.array([b]))[1][0])
        return self.known[a, b]

    def cut(self, segment: str) -> list[str]:
        """The parts of a segment that merges never join."""
        out, at, inner = [], 0, self.inner
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in inner:
                out.append(segment[at:k])
                at = k
        out.append(segment[at:])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes: the first space mark goes, byte pieces join up."""
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:] if ids and self.names[ids[0]].startswith(SPACE) else text


_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


def _segments(text: str) -> list[str]:
    """What follows the first space mark of each segment."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]


class _Encoder:
    def __init__(self, model: PieceModel, limit: int):
        self.model, self.memo = model, worker_memo(("pieces", model.size, hash(tuple(model.names[:2000]))), limit)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of segments (without their first space mark), put together from parts that occur in many."""
        parts = [[SPACE + x] if x.isalpha() else self.model.cut(SPACE + x) for x in new]
        own = list({y for p in parts for y in p})
        ids: dict[str, bytes] = {}
        for k in range(0, len(own), 50_000):
            some = own[k : k + 50_000]
            ids.update(zip(some, self.model.encode_segments(some), strict=True))
        return {x: b"".join([ids[y] for y in p]) for x, p in zip(new, parts, strict=True)}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, bytes]:
        """Offsets, and the ids of all texts one after another."""
        parts, segments = [_segments(t) for t in texts], set()
        for p in parts:
            segments.update(p)
        get = self.memo.prepare(segments, self._learn).__getitem__
        rows = [b"".join(map(get, p)) for p in parts]
        return np.cumsum([0, *(len(r) // 4 for r in rows)]), b"".join(rows)


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", memo: int = 200_000) -> DataFrame:
    """(``id_col``, ``ids_col`` array<int>): each text as the sentencepiece library encodes it, without
    begin and end ids or sampling. Rows are independent: repeated rows and null ids pass through; null
    texts count as empty and give an empty array. Only the two columns are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a vocabulary file: its size is fixed
    rows = docs.select(F.col(id_col).alias("_id"), raw_text(text_col).alias("_text"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encoder = _Encoder(worker_made("pieces", shared.value, PieceModel), memo)
        for batch in batches:
            for lo, hi in bounded(batch.column(1)):
                texts = [str(x, "utf-8", "replace") for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                offsets, flat = encoder.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["_id", "_ids"])

    return rows.mapInArrow(tidy(run), f"_id {kind}, _ids array<int>").toDF(id_col, ids_col)


def bounded(column: pa.Array, most: int = 8_000_000):
    """Row ranges of a batch that hold about ``most`` bytes each, at least one row."""
    sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in column)])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + most, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def id_lists(column: pa.Array):
    """The lists of a column, empty ones for nulls; the ids come out of one buffer."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield flat[at : at + n]
        at += n


def decode_pieces(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``text_col``): the text of each array of ids; null arrays give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        table = worker_made("pieces", shared.value, PieceModel)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            texts = [str(table.decode(x), "utf-8", "replace") for x in id_lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "_text"])

    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(tidy(run), f"_id {kind}, _text string").toDF(id_col, text_col)


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text and returns counts and digests of the ids and the decoded text."""
    ids = encode_pieces(docs, model, id_col, text_col)
    table = ids.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        from hashlib import sha256

        pieces = worker_made("pieces", table.value, PieceModel)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            rows = list(id_lists(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([sha256(b",".join(map(pieces.digits.__getitem__, x))).hexdigest() for x in rows]),
                    pa.array([sha256(str(pieces.decode(x), "utf-8", "replace").encode()).hexdigest() for x in rows]),
                ],
                ["_id", "n", "i", "d"],
            )

    out = ids.mapInArrow(tidy(run), f"_id {kind}, n long, i string, d string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
