import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import ppm
from quire.llm.ppm import ORDER, codes, held_out, part_of_trie, score_texts, slices, stream


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def counts_of(texts):
    tries = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        f = stream(words_of(t))
        for i in range(ORDER, len(f)):
            for k in range(ORDER + 1):
                tries[k][f[i - k : i], f[i]] += 1
    return tries


def brute_score(tries, text):
    """Each byte by a plain walk from its longest context down, with exclusion."""
    f, total = stream(words_of(text)), 0.0
    for i in range(ORDER, len(f)):
        gone = set()
        for k in range(ORDER, -1, -1):
            own = {s: n for s in range(256) if (n := tries[k].get((f[i - k : i], s), 0)) and s not in gone}
            if not own:
                continue
            size = sum(own.values()) + len(own)
            if f[i] in own:
                total += math.log10(own[f[i]] / size)
                break
            total += math.log10(len(own) / size)
            gone |= set(own)
        else:
            total -= math.log10(256 - len(gone))
    return total


def corpus(n=90):
    rng = random.Random(2)
    kinds = {"x": ["Alpha", "beta", "gamma", "delta", "epsilon", "éa", "zz"], "y": ["ein", "zwei", "drei", "über", "漢字", "vier"]}
    rows = []
    for i in range(n):
        kind = rng.choice("xy")
        rows.append((i, " \n".join(rng.choice(kinds[kind]) for _ in range(rng.randint(0, 30))), kind, "k"))
    return [*rows, (200, None, None, "k"), (200, "", None, None), (None, "alpha unseen", "x", None), (None, "q" * 300, "x", None)]


def test_slices_cover_every_byte_once(monkeypatch):
    monkeypatch.setattr(ppm, "SLICE", 7)
    parts = [words_of(t) for t in ["ab c", "", "dd", "a b c d e f g", "", ""]]
    got = [(int(c), int(o)) for code, owner in slices(parts) for c, o in zip(code, owner, strict=True)]
    want = [(int(c), i) for i, p in enumerate(parts) for c in codes(np.frombuffer(stream(p), np.uint8))]
    assert got == want
    assert got[0][0] == int.from_bytes(b"      a", "big")


def test_probabilities_sum_to_one():
    code = codes(np.frombuffer(stream([b"abc", b"abd", b"xbc"]), np.uint8))
    code, count = np.unique(code, return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    for c, n in zip(code.tolist(), count.tolist(), strict=True):
        pairs[c >> 8 & 255, c & 255] += n
    trie = part_of_trie(code, count, pairs)
    for context in (b"      ", b" abc a", b"qqqqqq", b"abd xb"):
        all_bytes = int.from_bytes(context + b"\0", "big") + np.arange(256)
        assert abs((10 ** trie.scores(all_bytes, np.full(256, ORDER))).sum() - 1) < 1e-9


@pytest.mark.parametrize("chunk", [300, 1_000_000])
def test_documents_equal_a_plain_walk(spark, chunk, monkeypatch):
    """Scores, baseline and counts of whole documents of two languages, over many chunks and over one."""
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, _text string").repartition(3)
    out = score_texts(docs, ~held_out(), chunk=chunk).collect()
    training = [t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    train = Counter()
    for t in training:
        train.update(words_of(t) + [None])
    tries, total, types = counts_of(training), sum(train.values()), len(train)
    want = []
    for i, t, *_ in rows:
        tokens = words_of(t) + [None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        want.append((i, len(tokens), sum(train[w] > 0 for w in tokens), total, base, brute_score(tries, t)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert len(out) == len(want)
    for a, b in zip(sorted((tuple(r) for r in out), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-4 * max(1, -b[5] / 100)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in score_texts(docs, F.lit(None).cast("boolean")).collect()}
    assert abs(out[2].score + math.log10(256)) < 1e-6 and abs(out[1].score + 5 * math.log10(256)) < 1e-5
    assert out[1].n_known == 0 and out[1].train_tokens == 0
    assert score_texts(docs.limit(0), ~held_out()).count() == 0
    swapped = spark.createDataFrame([(0, "one two three four"), (1, "one two three four"), (2, "four two one three")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(swapped, F.col("doc_id") < 2).collect()}
    assert got[0] > got[2] + 1  # the order of words counts


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SLICE", 50_000)
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, "x" * 200_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in score_texts(docs, ~held_out()).collect()}
    assert out[1].n_tokens == 60_001 and out[3].n_tokens == 2 and all(r.score < 0 for r in out.values())
