import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup
from quire.llm.exact_dedup import exact_groups


def norm(text):
    out, gap = [], False
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            gap = True
            continue
        out += [" "] * gap + [c]
        gap = False
    return "".join(out) + " " * gap


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randint(0, 90))) for _ in range(12)]
    texts = [None, "", " ", "\n\n", "x", "x ", " x", "a\xa0b", "a b", "A b", "y" * 64, "y" * 65, "z" * 5000]
    return texts + [rng.choice(base).replace(" ", rng.choice([" ", "  ", "\t"])) for _ in range(80)]


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, clash, monkeypatch):
    if clash:  # all blocks of one length share a key
        monkeypatch.setattr(exact_dedup, "block_key", lambda b: F.xxhash64(F.length(b)))
    texts = corpus()
    docs = spark.createDataFrame([(2 * i + 1, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int").repartition(4)
    out = sorted(exact_groups(docs, block_bytes=16).collect(), key=lambda r: r.doc_id)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(2 * i + 1)
    want = [(2 * i + 1, groups[norm(t)][0], len(groups[norm(t)]), groups[norm(t)][0] == 2 * i + 1, sha256(norm(t).encode()).hexdigest()) for i, t in enumerate(texts)]
    assert [tuple(r) for r in out] == want


def test_repeated_null_and_text_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")], "doc_id long, text string")
    out = exact_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True)]
    named = spark.createDataFrame([("n", "a"), ("m", "a")], "name string, body string")
    assert {r.keep_id for r in exact_groups(named, "name", "body").collect()} == {"m"}
    assert exact_groups(docs.limit(0)).count() == 0
