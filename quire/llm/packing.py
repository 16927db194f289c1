"""Packing of tokenised documents into windows by best-fit decreasing.

Documents are tokenised and cut where they are longer than a window: full windows stand alone, the rest
are pieces. Pieces are dealt by hash to shards of a bounded number of pieces, and each shard packs its
pieces in decreasing length. A segment tree indexed by remaining capacity counts the open windows, so
the tightest window that still fits is found in a few steps. Each shard can leave at most one badly
filled window, so padding stays small however large the input is. Only lengths and checksums move.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, raw_text, tidy, worker_made, worker_memo, written
from .piece_tokenizer import bounded

#: Pieces a shard packs at most on average. A shard is one task's memory.
SHARD = 8192
#: Text bytes tokenised at once: the list of their words is the largest thing a worker holds besides what it learnt.
AT_ONCE = 1_000_000
#: The steps before the merges that ``_tokens`` reproduces.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: What the steps cut off plain text in lower case, where all that is not ASCII is letters: endings after an apostrophe,
#: digits, runs of signs. What white space and these leave are runs of letters.
_SIGNS = re.compile(rb"([!-@\[-`{-~](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<=[0-9])|(?<![0-9])[!-/:-@\[-`{-~]*))")
#: Bytes of plain text: ASCII without control characters, and U+00C0 to U+017F, which are letters but for three.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
#: Times, divided by, and the capital whose lower case is two characters.
_OTHERS = tuple(c.encode() for c in "×÷İ")


def _plain(text: bytes) -> bool:
    """Whether ``_tokens`` cuts the text as the library does: composition changes none of its characters, lowering each to
    one letter, no version of Unicode disagrees on them, and no special token is in it."""
    if text.translate(None, _PLAIN) or b"<|" in text:
        return False
    if text.isascii():
        return True
    if any(c in text for c in _OTHERS):
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _tokens(text: bytes) -> list[bytes]:
    """What the steps cut plain text into."""
    return b" ".join(_SIGNS.split(text.lower() if text.isascii() else text.decode().lower().encode())).split()


class _Vocabulary:
    """The library's tokenizer and, if its steps are ``_STEPS``, two that share its merges and take
    ``_tokens``, split at spaces, as they are: for ASCII, and for others."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.merging, self.last = Tokenizer.from_str(spec), None, None
        steps = json.loads(spec)
        model, special = steps["model"], all("<|" in t["content"] and not t["normalized"] for t in steps["added_tokens"])
        if all(steps[k] == v for k, v in _STEPS.items()) and special and model["type"] == "BPE" and not model["dropout"] and model["end_of_word_suffix"]:
            bytes_shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # ASCII shows itself
            self.merging = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
            self.merging[0].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.merging[1].pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_shown])
            vocab = model["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
            self.last[[i for t, i in vocab.items() if t.endswith(model["end_of_word_suffix"])]] = True


class WordCache:
    """A vocabulary of the ``tokenizers`` library that never joins symbols over ASCII white space.

    Plain text (``_plain``) is lowered and cut at once, if the vocabulary's steps are known; other words, and
    all words of other vocabularies, go through the library whole. Distinct tokens and words are merged once per task.
    """

    MARK = "\x02"

    def __init__(self, spec: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.vocabulary = worker_made("vocabulary", spec, _Vocabulary)
        self.memo = worker_memo(("words", hash(spec)), limit)
        self.mark = self._ids(self.MARK)
        if len(self.mark) != 1:
            raise ValueError("the separator must be one token")

    def _ids(self, text: str) -> list[int]:
        return self.vocabulary.whole.encode(text, add_special_tokens=False).ids

    def _learn_whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids = np.array(self._ids(f" {self.MARK} ".join(str(w, "utf-8", "replace") for w in some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some) - 1:  # a word holds the separator
                out.update((w, np.array(self._ids(str(w, "utf-8", "replace")), "<u4").tobytes()) for w in some)
                continue
            flat = ids.tobytes()
            starts, ends = np.r_[0, cuts + 1] * 4, np.r_[cuts, len(ids)] * 4
            out.update((w, flat[a:b]) for w, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True))
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        if not self.vocabulary.merging:
            return self._learn_whole(words)
        out, rest, kinds = {}, [], ([], [])
        for w in words:
            (kinds[not w.isascii()] if w.isalpha() or _plain(w) else rest).append(w)
        for merging, tokens in zip(self.vocabulary.merging, kinds, strict=True):
            joined = [b" ".join(tokens[k : k + 512]).decode() for k in range(0, len(tokens), 512)]
            for k, found in enumerate(merging.encode_batch_fast(joined, add_special_tokens=False)):
                some, ids = tokens[512 * k : 512 * k + 512], np.array(found.ids, "<u4")
                ends = (np.flatnonzero(self.vocabulary.last[ids]) + 1) * 4
                if len(ends) != len(some):  # a byte is not in the vocabulary
                    rest += some
                    continue
                out.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        out.update(self._learn_whole(rest))
        return out

    def _cut(self, text: bytes) -> list[bytes]:
        """The tokens of plain words and, as they are, the other words."""
        if not self.vocabulary.merging:
            return text.split()
        if _plain(text):
            return _tokens(text)
        out = []
        for plain, words in groupby(text.split(), _plain):
            out += _tokens(b" ".join(words)) if plain else words
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts, words = [self._cut(t) for t in texts], set()
        for p in parts:
            words.update(p)
        get = self.memo.prepare(words, self._learn).__getitem__
        return [b"".join(map(get, p)) for p in parts]


def cut_pieces(rows: DataFrame, spec: str, end_id: int, window: int) -> DataFrame:
    """(row, start, length, ids_crc32, doc_tokens) of each document's pieces; ``rows`` has ``_row``, ``_text``."""
    shared = rows.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: its size is fixed
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = WordCache(shared.value)
        for batch in batches:
            for lo, hi in bounded(batch.column(1), AT_ONCE):
                ids, out = batch.column(0).slice(lo, hi - lo).to_pylist(), []
                for row, flat in zip(ids, words.encode(batch.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    flat += end
                    n = len(flat) // 4
                    out += [(row, k, min(window, n - k), zlib.crc32(flat[4 * k : 4 * (k + window)]), n) for k in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [ROW, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.select(ROW, "_text").mapInArrow(tidy(run), f"{ROW} long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities 0 to ``size`` holds their counts."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        k = capacity + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The fullest window with room for ``need``: (capacity, window), removed from the tree."""
        k, count = need + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k *= 2
                if not count[k]:
                    k += 1
        capacity = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """The window and the offset of each piece (1 to ``size`` long), and the number of windows.
    Pieces of equal length go in the order given."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    opened, tree = 0, OpenWindows(size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            capacity, window = size, opened
            opened += 1
        else:
            capacity, window = found
        where[i], offset[i] = window, size - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], window)
    return where, offset, opened


def pack(pieces: DataFrame, window: int, shard: int = SHARD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: pieces fill windows without gaps from 0 on.

    Full pieces are sequences by themselves. ``sequence_id`` is (shard number << 32) + window number.
    """
    n = pieces.count()
    shards = max(1, -(-n // shard))
    names = [c for c, _ in pieces.dtypes]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(ROW, "ascending"), ("start", "ascending")])
        where, offset, _ = best_fit_decreasing(table["length"].to_pylist(), window)
        first = table["_shard"][0].as_py() << 32 if len(table) else 0
        return table.select(names).append_column("sequence_id", pa.array([first + w for w in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(ROW, "start"), F.lit(shards)))
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return dealt.groupBy("_shard").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = 2048, shard: int = SHARD) -> DataFrame:
    """Tokenises, cuts and packs all documents; one row per piece with ``id_col``, start, length,
    ids_crc32, doc_tokens, sequence_id and offset.

    ``spec`` is the JSON text of a vocabulary of the ``tokenizers`` library; ``end_id`` closes each
    document, so an empty or null text is one token. Repeated rows and null ids are documents of their
    own. An empty table gives an empty result. Only the two columns are read.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    rows = keyed(source, "_id")
    pieces = written(cut_pieces(rows.select(ROW, raw_text("_body").alias("_text")), spec, end_id, window), "pieces")
    packed = pack(pieces, window, shard)
    return packed.join(rows.select(ROW, F.col("_id").alias(id_col)), ROW).select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
