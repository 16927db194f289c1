import random
from hashlib import sha256

import pytest

from quire.llm.chat import as_events, chat_digests, fold, format_chats, read_back, render


def test_fold():
    log = [(1, "start", "user", None), (2, "start", "assistant", ""), (2, "delta", None, "He"), (1, "delta", None, "hi"), (2, "regenerate", None, None), (2, "delta", None, "Yes"), (1, "edit", None, "hello"), (3, "delta", "user", "x"), (3, "delete", None, None)]
    assert fold(log) == [("user", "hello"), ("assistant", "Yes")]
    assert fold([*log, (3, "regenerate", None, "back")])[-1] == ("user", "back")
    assert fold([(None, None, None, None)]) == [("", "")]
    with pytest.raises(ValueError):
        fold([(1, "other", "user", "")])


def test_template_is_reversible():
    rng = random.Random(4)
    bits = ["\\", "### ", "</turn>", "\n", "a", "<", "/turn>", "#", " ", "é🙂", "Assistant:"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "ro\nle\\", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = render(turns)
        assert read_back(text) == turns
        assert len(spans) == sum(r == "assistant" for r, _ in turns)
    assert read_back(render([("user", "x" * 300_000)])[0])[0][1] == "x" * 300_000


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "a" * 1000, "x"), (1, 1, "assistant", "a" * 1000, "x"), (None, 0, "user", None, None), (2, None, None, "odd", None), (2, 0, "assistant", "", None)]
    rows += [(3, t, "assistant" if t % 2 else "user", f"### {t} </turn> \\ é" * t, "y") for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    out = {r.conv_id: r for r in chat_digests(format_chats(as_events(frame))).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        learnt = "".join(t for r, t in turns if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(turns) and got.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(learnt), sha256(learnt.encode()).hexdigest())
    assert format_chats(as_events(frame.limit(0))).count() == 0
