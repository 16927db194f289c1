import random
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import pytest

from quire.llm.piece_tokenizer import PieceModel, _Encoder, decode_pieces, encode_pieces, id_lists, piece_digests

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def sample():
    rng = random.Random(5)
    fixed = ["", " ", "  ", "a", " a", "a ", "     x     y    ", "\n\t\x00", "▁▁ a▁b", "abab" * 40, "a" * 300, " " * 100]
    fixed += ["x" + " " * 40 + "y", "ünï 漢字🙂🙂 é", "<s></s><unk><0x41>", "==== ---- ____" * 5, "banana" * 50]
    fixed += [" " * n for n in range(60)]
    return fixed + ["".join(rng.choice("abcdeths in▁ \n") for _ in range(rng.randint(1, 300))) for _ in range(500)]


def test_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts, model = sample(), PieceModel(MODEL)
    import numpy as np

    offsets, flat = _Encoder(model, 1000).encode(texts)
    ids = np.frombuffer(flat, "<i4")
    for i, text in enumerate(texts):
        want = library.encode(text)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text
        assert model.decode(want).decode() == library.decode(want)


def test_frames_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (1, "a b", None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_pieces(docs, MODEL)
    back = sorted((r.doc_id or 0, r.text) for r in decode_pieces(out, MODEL).collect())
    assert back == [(0, "a b"), (1, ""), (1, "a b"), (3, "")]
    assert {r.n_tokens for r in piece_digests(docs, MODEL).collect()} == {0, 2}
    assert piece_digests(docs.limit(0), MODEL).count() == 0


def test_lists_of_slices_and_nulls():
    column = pa.array([[1, 2], None, [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    assert list(id_lists(column)) == [[1, 2], [], [], [3], [4, 5, 6]]
    assert list(id_lists(column.slice(1, 3))) == [[], [], [3]] and list(id_lists(column.slice(0, 0))) == []


def test_digests_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    digest = lambda b: sha256(b).hexdigest()
    texts = sample()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text)
        assert got[k] == (len(ids), digest(",".join(map(str, ids)).encode()), digest(library.decode(ids).encode()))
