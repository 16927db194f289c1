import itertools
import random

import numpy as np

from quire.llm.toxicity import END, START, CharModel, Scorer, char_model, fit, held_out, lattice, logistic, restore, score_toxicity, spread, tokens, viterbi

WORDS = {w: 50 for w in "idiot moron stupid trash loser clown the and house letter book free see all worthless".split()}
CHARS = CharModel.of(WORDS)


def test_restores_obfuscated_words():
    for token, want in [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("$tupid", "stupid"), ("stuuuupid,", "stupid"), ("tr@sh", "trash"), ("l0s3r.", "loser"), ("House", "house"), ("letter", "letter"), ("freeee", "free"), ("2024", "2024"), ("", ""), ("!!!", "")]:
        assert restore(token.encode(), CHARS) == want, token
    assert restore(b"$tr@$h", CHARS) == "strash" and restore(b"4$$", CharModel.of(WORDS | {"ass": 50})) == "ass"


def test_numbers_stay_where_they_are_likelier():
    model = CharModel.of({"ass": 5, "1455": 40, "455": 60, "$100": 9})
    assert [restore(x, model) for x in (b"455", b"4$$", b"$100", b"1455")] == ["455", "ass", "$100", "1455"]


def test_spread_letters_are_parted_into_words():
    model = CharModel.of(WORDS | {"you": 90, "a": 90, "such": 40, "an": 40, "été": 50, "ты": 50, "дурак": 50})
    for text, run, want in [
        ("an i d i o t here", "i d i o t", "idiot"),
        ("x m.0.r.0.n!", "x m.0.r.0.n", None),
        ("see m.0.r.0.n!", "m.0.r.0.n", "moron"),
        ("such a i d i o t", "a i d i o t", "a idiot"),
        ("y o u i d i o t", "y o u i d i o t", "you idiot"),
        ("y-o-u  m-0-r-o-n", "y-o-u  m-0-r-o-n", "you moron"),
        ("(é t é)", "é t é", "été"),
        ("т ы   д у р а к", "т ы   д у р а к", "ты дурак"),
    ]:
        found = {t.decode() for t in tokens(text.encode()) if len(t.split()) > 1 or t.decode() == run}
        assert run in found, text
        if want:
            assert restore(run.encode(), model) == want, text
    assert tokens(b"plain words, no a b runs") == {b"plain", b"words,", b"no", b"a", b"b", b"runs"}
    long = " ".join("idiot" * 5000).encode()
    assert set(restore(long, model).split(" ")) <= {"idiot", "idi", "ot", "id", "iot"}


def test_spread_reading_is_of_least_cost():
    rng = random.Random(7)
    for _ in range(40):
        parts = [rng.choice("aio103t")]
        for _ in range(rng.randint(2, 3)):
            parts += [rng.choice([" ", "  ", "."]), rng.choice("aio103t")]
        places = spread(parts)

        def cost(reads):
            words = "".join(x for x, _ in reads).split(" ")
            framed = [START + START + w + END for w in words]
            return sum(p for _, p in reads) + sum(CHARS.cost(f[i : i + 2], f[i + 2]) for f in framed for i in range(len(f) - 2))

        best = min(map(cost, itertools.product(*places)))
        got = viterbi(places, CHARS)
        assert any("".join(x for x, _ in r) == got and abs(cost(r) - best) < 1e-9 for r in itertools.product(*places))


def test_character_model_counts_all_documents(spark):
    texts = ["One two two", "two 1455 x9", None, "", "One, more! $100 …"] * 7
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = CharModel.of({"one": 14, "two": 14, "1455": 7, "more": 7, "$100": 7})
    assert char_model(docs) == want
    assert char_model(docs.limit(0)) == CharModel.of({})
    assert len(char_model(docs, most=5).three) == 5


def test_viterbi_is_the_least_cost_reading():
    rng = random.Random(6)
    for _ in range(60):
        token = "".join(rng.choice("aio1003$tt") for _ in range(rng.randint(1, 6)))
        places = lattice(token)

        def cost(reads):
            word = "".join(x for x, _ in reads)
            framed = START + START + word + END
            return sum(p for _, p in reads) + sum(CHARS.cost(framed[i : i + 2], framed[i + 2]) for i in range(len(framed) - 2))

        best = min(map(cost, itertools.product(*places)))
        got = viterbi(places, CHARS)
        assert any("".join(x for x, _ in r) == got and abs(cost(r) - best) < 1e-9 for r in itertools.product(*places))


def test_logistic_separates():
    x = np.array([[0.0], [0.1], [0.2], [3.0], [3.1], [2.9]])
    a, b = logistic(x, np.array([0, 0, 0, 1, 1, 1.0]))
    assert a < 0 < b and logistic(x, np.zeros(6))[1] == 0


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    bad, good = ["idiot", "moron", "scum"], ["".join(rng.choice("abdeors") for _ in range(5)) for _ in range(400)]
    hidden = {"idiot": "1d1ot", "moron": "m o r o n", "scum": "scuuum"}
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(good) for _ in range(30)]
        y = int(i % 4 == 0)
        if y:
            w = rng.choice(bad)
            words[rng.randrange(30)] = hidden[w] if i % 3 == 0 else w
        rows.append((i, " ".join(words), y, "x"))
        labels.append((i, y, 0.0))
    rows += [(None, "idiot", 0, None), (1, None, 0, None), (1, "", 0, None)]
    labels += [(None, 1, 0.0), (5, None, 0.0), (999_999, 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, score double")
    model = fit(docs, marks.where(~held_out()))
    scored = score_toxicity(docs, model)
    assert scored.count() == len(rows)
    out = scored.where(held_out()).collect()
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None)
    assert right >= 0.97 * len(out)
    empty = fit(docs.limit(0), marks)
    assert Scorer(empty).model.score(Scorer(empty).stats(b"")) < 0.7
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_repeated_ids_give_one_model(spark):
    """Of an id with several texts or labels one is taken, whatever the order of rows."""
    from quire.llm.toxicity import fit

    rows = [(i % 30, f"word{i} text {'awful' if i % 2 else 'nice'} more{i % 7}") for i in range(90)]
    labels = spark.createDataFrame([(i % 30, i % 2) for i in range(60)] + [(3, 1), (3, 0)], "doc_id long, toxic int")
    models = [fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert models[0] == models[1]
