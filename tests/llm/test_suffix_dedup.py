import random
from hashlib import sha256

import numpy as np
import pytest

from quire.llm import repeats
from quire.llm.repeats import first_windows, planes, unplanes
from quire.llm.suffix_dedup import remove_repeats


def brute(texts: list[bytes], width: int):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha256(kept).hexdigest()))
    return out


def corpus(seed: int):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc de\n") for _ in range(rng.randint(50, 900))) for _ in range(12)]
    texts = ["", None, "x" * 99, "x" * 100, "y" * 700, "y" * 333, "ab" * 200, "ba" * 200, "é" * 120, base[0], base[0], base[1] + base[2]]
    for _ in range(40):
        parts = [b[i : i + rng.randint(0, 300)] for b in rng.choices(base, k=3) for i in [rng.randrange(len(b))]]
        texts.append(rng.choice(["", " zz "]).join(parts) + "q" * rng.choice([0, 150]))
    return texts


@pytest.mark.parametrize("width", [100, 20])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr("quire.llm.suffix_dedup.TILE", 257)
    texts = corpus(width)
    docs = spark.createDataFrame([(3 * i + 1, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    out = sorted(remove_repeats(docs, width=width).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == brute([(t or "").encode() for t in texts], width)


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(1, body), (1, body), (None, body), (None, None), (2, "short")], "doc_id long, text string")
    out = remove_repeats(docs).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 0, 400, 400]
    assert [r.n_removed for r in out if r.doc_id is None and r.n_bytes] == [400]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_first_windows_with_clashing_names():
    rng = np.random.default_rng(1)
    for _ in range(50):
        name, check = rng.integers(0, 6, 40).astype(np.uint64) << np.uint64(rng.integers(0, 40)), rng.integers(0, 2, 40).astype(np.uint64)
        seen, want = set(), []
        for p in zip(name.tolist(), check.tolist(), strict=True):
            want.append(p in seen)
            seen.add(p)
        assert first_windows(name, check).tolist() == want
    x = rng.integers(0, 2**63, 9)
    assert (unplanes(planes(x), np.int64) == x).all() and repeats.merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
