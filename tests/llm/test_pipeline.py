import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_jaccard_join import shingles
from test_substring_dedup import brute as brute_words

from quire.llm.packing import WordCache


def fixture(spark, folder):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdeors") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(30, 80))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron"])
        if i % 23 == 1:
            words += passage.split()
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(400 + k, docs[k * 7 + 1][1].replace(" ", "\n", 1), "en", "t") for k in range(20) if (k * 7 + 1) % 5]
    for k in range(20):
        base = docs[k * 9 + 2]
        if base[0] % 5:
            docs.append((500 + k, base[1] + " " + word(), "en", "near"))
    docs += [(600, None, None, None), (601, "", "en", "s"), (602, "  ", "en", "s")]
    frame = spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return frame


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    now = fixture(spark, folder)
    columns = now.dtypes
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    rows = lambda df: sorted(map(tuple, df.collect()))

    before = rows(now)
    now = stages["toxicity"](spark, now, folder).cache()
    assert now.dtypes == columns
    toxic = {r[0] for r in before if any(w in (r[1] or "") for w in ("idiot", "moron"))}
    assert rows(now) == [r for r in before if r[0] not in toxic]

    before = rows(now)
    now = stages["exact_dedup"](spark, now, folder).cache()
    assert now.dtypes == columns
    seen, want = set(), []
    for r in before:
        norm = " ".join((" " + (r[1] or "") + " ").split(" ")) if not (r[1] or "").strip() else " ".join(r[1].split())
        norm = norm if (r[1] or "").strip() else ("" if not r[1] else " ")
        if norm not in seen:
            want.append(r)
        seen.add(norm)
    assert rows(now) == want

    before = rows(now)
    now = stages["near_dedup"](spark, now, folder).cache()
    assert now.dtypes == columns
    sets = [shingles(r[1], 5) for r in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert rows(now) == [r for i, r in enumerate(before) if label[i] == i]

    before = rows(now)
    now = stages["substring_dedup"](spark, now, folder).cache()
    assert now.dtypes == columns
    for r, old, (_, removed, _) in zip(rows(now), before, brute_words([(r[1] or "").encode() for r in before], 20), strict=True):
        assert r[0] == old[0] and (r == old) == (removed == 0) and len((old[1] or "").split()) - len((r[1] or "").split()) == removed

    before = {r[0]: r[1] for r in rows(now)}
    pieces = stages["packing"](spark, now, folder).collect()
    words = WordCache(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for i, text in before.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(np.frombuffer(words.encode([(text or "").encode()])[0], "<u4")) + 1
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_with_the_names_stages_use(spark, tmp_path):
    """Every stage keeps columns that are called as its own are, and their values."""
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(30))
    texts = [f"{passage} one", f"two {passage}", "same text here", "same text here", None, ""]
    names = ["_row", "_kept", "n_removed", "kept", "_text", "_id", "score", "c0", "c1", "component_id", "label", "n_chars"]
    rows = [(i, t, *([i * 100] * len(names))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == r.doc_id * 100 for n in names if n != "n_chars"), name
