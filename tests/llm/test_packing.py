import random
import zlib

import numpy as np
import public_tokenizers

from quire.llm.packing import WordCache, best_fit_decreasing, pack_documents

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def test_word_cache_equals_the_library():
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_str(SPEC), WordCache(SPEC)
    texts = ["", " ", "It's, a\ttest\n\nof  WORDS. 12 x\x02y \x02 é é 漢字 🙂", "á ́b", "don't 'll x'll <|endoftext|>z", "\x85\xa0 q\x1c"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abé'sT,. \n\t12́ß|") for _ in range(200)) for _ in range(200)]
    for text, got in zip(texts, cache.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_word_cache_equals_the_library_on_every_letter_and_point():
    """Every code point before a closing point, all points after those that change when lowered or composed,
    and every capital with every combining mark."""
    import string
    import unicodedata

    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_str(SPEC), WordCache(SPEC, 20_000)
    every = [c for c in map(chr, range(33, 0x1F000)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    words = [f"{c}," for c in every if ord(c) < 0x3000 or ord(c) % 7 == 0]
    odd = [c for c in every if c.lower() != c or unicodedata.normalize("NFC", c) != c or ord(c) < 0x250]
    words += [c + p for c in odd for p in ".;:!?"]
    words += [f"{c}{m}{t}" for c in string.ascii_letters for m in map(chr, range(0x300, 0x370)) for t in ("", ",", "x.")]
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    for text, got, ids in zip(texts, cache.encode([t.encode() for t in texts]), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.ids, text


def test_ids_equal_the_library_on_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_str(SPEC), WordCache(SPEC)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert len(texts) >= 100
    for text, got in zip(texts, cache.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_that_differ_in_case_and_signs_are_merged_once():
    from quire.llm import common

    common._MEMOS.clear()
    cache = WordCache(SPEC)
    whole = []
    cache._learn_whole = lambda words: whole.extend(words) or {}  # the library's own steps
    cache.encode(["Quaüze, quaüze. QUAÜZE%%% (quaüze) quaüze's 7 vex'd".encode()])
    assert sorted(cache.memo.now) == sorted(w.encode() for w in ["quaüze", ",", ".", "%%%", "(", ")", "'s", "7", "vex", "'d"]) and not whole


def test_other_vocabularies_equal_the_library():
    """Without the lowering step, and with a special token that a word may hold, nothing may be cut as for the known one."""
    import json

    from tokenizers import Tokenizer

    upper, special = json.loads(SPEC), json.loads(SPEC)
    upper["normalizer"]["normalizers"].pop()
    special["added_tokens"][0]["content"] = "able"
    special["model"]["vocab"]["able"] = special["model"]["vocab"].pop("<|startoftext|>", 49406)
    for spec in map(json.dumps, (upper, special)):
        plain, cache = Tokenizer.from_str(spec), WordCache(spec)
        for text in ["Enable, the TABLE's x", "ÉTÉ able 12 a<|endoftext|>b"]:
            assert np.frombuffer(cache.encode([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_plain_words_beside_others_equal_the_library():
    """Texts of plain and other words mixed, endings after signs, invalid bytes, control characters, long runs."""
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_str(SPEC), WordCache(SPEC)
    rng = random.Random(5)
    parts = ["It", "'S", "'d", "''ll", "a's't", "$'re", "9'm", "1,234.5", "É", "İx", "ŉ", "ſt", "×", "÷", "²", "ª", "ß", "ĲY", "—", "x—y", "\x1f", "\x7f", "e\u0301", "漢", "<|", "<|endoftext|>", "|>", "||", "Σς", "ΑΣ", " ", "\n", "\x85", "\xa0", "_", "a" * 300, "!" * 300]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for text, got, ids in zip(texts, cache.encode([t.encode() for t in texts]), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.ids, text
    for bad in [b"ab\xff cd", b"\x80 x", b"\xc3", b"x\xc3 y"]:
        assert np.frombuffer(cache.encode([bad])[0], "<u4").tolist() == plain.encode(bad.decode("utf-8", "replace"), add_special_tokens=False).ids


def brute_best_fit(lengths, size):
    room, where, offset = [], [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if not fit:
            room.append(size)
            fit = [(size, len(room) - 1)]
        least = min(fit)[0]
        w = [w for r, w in fit if r == least][-1]
        where[i], offset[i] = w, size - room[w]
        room[w] -= lengths[i]
    return where, offset, len(room)


def test_best_fit_uses_as_many_windows_as_a_plain_search():
    rng = random.Random(1)
    for size in (1, 7, 64, 100):
        for _ in range(30):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
            where, offset, n = best_fit_decreasing(lengths, size)
            assert n == brute_best_fit(lengths, size)[2]
            for w in range(n):
                own = sorted((o, length) for v, o, length in zip(where, offset, lengths, strict=True) if v == w)
                assert all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= size


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 1, 5, 700, 5000]))), "k") for i in range(40)]
    rows += [(40, None, None), (40, None, None), (None, "null id", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = [r.asDict() for r in pack_documents(docs, SPEC, shard=16).collect()]
    ids = {i: np.frombuffer(WordCache(SPEC).encode([t.encode()])[0] + b"\1\0\0\0", "<u4") for i, t, _ in rows[:40]}
    for i, want in ids.items():
        own = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == i)
        assert sum(n for _, n in own) == len(want) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        for r in out:
            if r["doc_id"] == i:
                assert r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(want)
    assert sorted(r["doc_tokens"] for r in out if r["doc_id"] == 40) == [1, 1]
    assert sum(r["doc_id"] is None for r in out) == 1
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and sum(s[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert pack_documents(docs.limit(0), SPEC).count() == 0
