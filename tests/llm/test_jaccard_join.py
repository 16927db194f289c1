import random

import numpy as np
import pytest

from quire.llm import jaccard_join
from quire.llm.common import raw_text
from quire.llm.components import components
from quire.llm.jaccard_join import Parts, jaccard_components, link_block, may_link, need, shared_least, shown, token_sets, union_bits


def shingles(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(texts, percent=85):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = [None, "", "  ", "one", "One ", "one two", "two one", "a b c d", "A B C D", "a b c d e", "x " * 50, "x " * 90]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 8, 11, 30, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 6])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ALL_PAIRS", block // 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", 4 * block)
    texts = corpus(block)
    docs = spark.createDataFrame([(2 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long".replace("n long", "n string")).repartition(3)
    out = sorted(jaccard_components(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id // 2) for r in out] == brute(texts)


def test_a_large_family_is_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):  # a long chain: neighbours are linked, ends are not
        w = list(base)
        for i in range(k // 6):
            w[5 * i % 120] = f"v{i}"
        texts.append(" ".join(w + [f"t{rng.randint(0, 3)}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(jaccard_components(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in out] == brute(texts)


def test_a_link_between_chunks_is_kept_where_one_is_hot(spark):
    base = [f"w{i}" for i in range(200)]
    inner = [f"x{i}" for i in range(12)] + base[12:]  # linked with the near copies of its chunk, not their smallest
    outer = inner[:100] + [f"y{i}" for i in range(12)] + inner[112:]  # linked with ``inner`` alone
    texts = [" ".join([*base, f"t{i}"]) for i in range(200)] + [" ".join(inner), " ".join(outer)] + [f"u{i} v{i}" for i in range(200)]
    want = brute(texts)
    assert {c for _, c in want[:202]} == {0}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 2), "_row long, text string")
    parts = Parts(len(texts))
    for r in jaccard_join._families(docs.select("_row", raw_text().alias("_text")), 4, 85, 4, (np.zeros(0, np.int64), np.zeros(0, np.uint8))).collect():
        parts.join(r.a, r.b)
    assert parts.find(201) == parts.find(200) == 0


def test_linked_sets_share_enough_of_what_they_show():
    rng = random.Random(5)
    gen = np.random.default_rng(5)
    level = gen.integers(0, 3, 1 << jaccard_join.CELL_BITS, np.uint8)
    for percent in (80, 85):
        for _ in range(3000):
            n = rng.choice([1, 2, 6, 7, 8, 12, 20, 40, 100, 300])
            a = gen.integers(0, 2**64, n, np.uint64)
            drop, add = rng.randint(0, n // 5), rng.randint(0, n // 5)
            b = np.r_[a[drop:], gen.integers(0, 2**64, add, np.uint64)]
            if len(b) and 100 * (n - drop) >= percent * (n + add):
                x, y = shown([np.sort(a), np.sort(b)], percent, level)
                assert len(np.intersect1d(x, y)) >= shared_least(min(len(a), len(b)), percent) >= 1


def test_a_bitmap_never_hides_a_linked_set():
    gen = np.random.default_rng(8)
    pool = gen.integers(0, 2**64, 60, np.uint64)
    for _ in range(300):
        block = [np.unique(gen.choice(pool, gen.integers(5, 30))) for _ in range(6)]
        q = np.unique(np.r_[gen.choice(block[0], len(block[0]) - 1, replace=False), gen.integers(0, 2**64, gen.integers(0, 4), np.uint64)])
        linked = any(100 * len(np.intersect1d(q, x)) >= 80 * len(np.union1d(q, x)) for x in block)
        assert may_link(q, union_bits(block), min(map(len, block)), max(map(len, block)), 80) or not linked
    assert need(7, 85) == 6


def test_near_copies_in_two_chunks_with_a_hot_passage(spark):
    """Hundreds of pages share one passage; a page of the second file is linked with one of the first only."""
    passage = [f"p{i}" for i in range(92)]
    texts = [" ".join([*passage, *(f"d{i}_{k}" for k in range(14))]) for i in range(999)]
    words = texts[415].split()
    words[95], words[101] = "changed", "again"
    texts.append(" ".join(words))
    want = brute(texts)
    assert want[999][1] == 415
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 2), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert [out[i] for i in range(1000)] == want


def test_pairs_of_a_group_grow_with_its_size_not_its_square(spark):
    """Groups of 20 and of 60 near copies, each row in a chunk of its own."""
    got = {}
    for size in (20, 60):
        texts = [" ".join([*(f"w{i}" for i in range(150)), f"t{k}"]) for k in range(size)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), size), "_row long, text string")
        pairs = jaccard_join._families(docs.select("_row", raw_text().alias("_text")), 5, 80, 4, (np.zeros(0, np.int64), np.zeros(0, np.uint8))).collect()
        parts = Parts(size)
        for r in pairs:
            parts.join(r.a, r.b)
        assert {parts.find(i) for i in range(size)} == {0}
        got[size] = len({(r.a, r.b) for r in pairs})
    assert got[60] <= 3 * got[20] + 3


def test_only_sets_that_may_be_linked_with_another_part_are_paired(spark, monkeypatch):
    """Pages that share some phrases, and near copies and copies that their signatures join: few make pairs."""
    paired, families = [], jaccard_join._families

    def spied(rows, *facts):
        paired.append(rows.count())
        return families(rows, *facts)

    monkeypatch.setattr(jaccard_join, "_families", spied)
    rng = random.Random(12)
    phrases = [[f"p{k}_{i}" for i in range(8)] for k in range(30)]
    texts = [" ".join([*(f"u{i}_{j}" for j in range(90)), *rng.choice(phrases)]) for i in range(150)]
    texts += [" ".join([*(f"w{i}" for i in range(400)), f"t{k % 20}"]) for k in range(60)]
    edge = [f"e{i}" for i in range(100)]
    texts += [" ".join(edge), " ".join([*edge[:93], *(f"f{i}" for i in range(7))])]
    rng.shuffle(texts)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 4), "doc_id long, text string")
    out = sorted(jaccard_components(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_shingles, r.component_id) for r in out] == brute(texts)
    assert len(paired) == 1 and paired[0] <= 4


def test_families_over_blocks_and_chunks_equal_brute_force(spark, monkeypatch):
    """Large families of near copies at the threshold: blocks, leaders, bitmaps and searches all take part."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LEADERS", 16)
    monkeypatch.setattr(jaccard_join, "QUERIES", 8)
    monkeypatch.setattr(jaccard_join, "UNIONS", 4)
    rng = random.Random(11)
    texts = []
    for size in (40, 90):
        base = [f"b{size}_{i}" for i in range(size)]
        for _ in range(160):
            w = list(base)
            for _ in range(rng.randint(0, size // 20)):
                w[rng.randrange(size)] = f"e{rng.randint(0, 40)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 4), "doc_id long, text string")
    for percent in (80, 85):
        out = sorted(jaccard_components(docs, percent=percent).collect(), key=lambda r: r.doc_id)
        assert [(r.n_shingles, r.component_id) for r in out] == brute(texts, percent)


def test_block_links_equal_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        sets = []
        for _ in range(rng.randint(1, 6)):
            base = [rng.getrandbits(64) for _ in range(rng.randint(0, 40))]
            sets += [np.array(sorted({x if rng.random() > 0.05 else rng.getrandbits(64) for x in base}), np.uint64) for _ in range(rng.randint(1, 8))]
        parts, want = Parts(len(sets)), Parts(len(sets))
        link_block(sets, 85, parts, group=4)
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    want.join(i, j)
        assert [parts.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 105), (105, 103), (200, 200), (7, None)]
    out = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100, 200: 200}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None), (9, "z")], "doc_id long, text string")
    out = jaccard_components(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 0, -1), (-1, 1, 5), (5, 1, 5), (5, 1, 5), (9, 1, 9)]
    assert jaccard_components(docs.limit(0)).count() == 0
    assert len(token_sets([b"a b"], 4)) == 1
