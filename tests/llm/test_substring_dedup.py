import random
from hashlib import sha256

import numpy as np
import pytest

from quire.llm.substring_dedup import Scheme, compress, remove_repeated_words


def brute(texts: list[bytes], width: int):
    seen, out = set(), []
    for t in texts:
        words = t.split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), int(gone.sum()), sha256(kept).hexdigest()))
    return out


def corpus(seed: int):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "a", "c", "word", "é", "Word"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 150))) for _ in range(12)]
    texts = ["", None, "x " * 19, "x " * 20, "y " * 170, "y\n" * 60, "a b " * 60, "b\ta " * 60, "a a b " * 40, base[0], base[0], base[1] + " " + base[2]]
    for _ in range(50):
        parts = [" ".join(b.split()[i : i + rng.randint(0, 60)]) for b in rng.choices(base, k=3) for i in [rng.randrange(8)]]
        texts.append(rng.choice([" ", " zz ", "  "]).join(parts) + " q" * rng.choice([0, 50]))
    return texts


@pytest.mark.parametrize("width", [20, 7])
def test_equals_brute_force(spark, width):
    texts = corpus(width)
    docs = spark.createDataFrame([(3 * i + 1, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    out = sorted(remove_repeated_words(docs, width=width).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in out] == brute([(t or "").encode() for t in texts], width)


def test_equal_stretches_have_equal_representatives():
    rng = random.Random(3)
    scheme = Scheme(20)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(20)]
        sides = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(4)]
        texts = [" ".join(a + words + b).encode() for a, b in (sides[:2], sides[2:])]
        owner, place, key, *_ = scheme._windows(texts)
        one = key[(owner == 0) & (place == len(sides[0]))]
        two = key[(owner == 1) & (place == len(sides[2]))]
        assert one == two


def test_rounds_shrink_and_cover():
    names = np.array([5, 5, 5, 7, 9, 7, 9, 11] * 50, np.uint64)
    start, end, *_ = compress(names, np.zeros(len(names), np.int64), 2)
    assert start[0] == 0 and end[-1] == len(names) and (start[1:] == end[:-1]).all() and len(start) < len(names) / 2


def test_repeated_and_null_ids(spark):
    body = " ".join(str(i) for i in range(30))
    docs = spark.createDataFrame([(1, body), (1, body), (None, body), (None, None), (2, "short")], "doc_id long, text string")
    out = remove_repeated_words(docs).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 0, 30, 30]
    assert remove_repeated_words(docs.limit(0)).count() == 0
