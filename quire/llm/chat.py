"""Chat formatting from an event log.

A conversation is a log of events: a message starts, streamed deltas add to it, an edit replaces its
text, a regeneration clears it for new deltas, a deletion removes it. Logs are partitioned by
conversation, sorted by sequence and folded in order into the final messages, which are then rendered
with a reversible template. A task holds one conversation at a time.

Template of a turn: ``### `` + role + newline + text + ``</turn>`` + newline. Inside roles and texts a
backslash goes before each backslash, ``### `` and ``</turn>`` (in roles before newlines too), so a
control string without a backslash is always the template's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "### ", "</turn>"
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE = re.compile(r"\\|### |</turn>|\n")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\\n]|\\.)*)\n", re.S)
_BODY = re.compile(r"(?:\\.|(?!</turn>)[^\\])*+", re.S)
#: Deltas the query cuts a text into.
DELTA = 256


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the final messages, in the order of their first event.

    ``events``: (message, kind, role, text) in sequence. Kinds: ``start``, ``delta``, ``edit``,
    ``regenerate``, ``delete``. A null text counts as empty, a null kind as ``delta``; a message seen
    first in another event starts there, a later role replaces an earlier one if it isn't null. An
    unknown kind is an error.
    """
    order: dict = {}
    for message, kind, role, text in events:
        entry = order.setdefault(message, [None, [], True])
        entry[0] = role if role is not None else entry[0]
        if kind in (None, "delta"):
            entry[1].append(text or "")
        elif kind == "edit":
            entry[1] = [text or ""]
        elif kind == "regenerate":
            entry[1], entry[2] = [text or ""], True
        elif kind == "delete":
            entry[2] = False
        elif kind == "start":
            entry[1].append(text or "")
        else:
            raise ValueError(f"unknown event kind {kind!r}")
    return [(role or "", "".join(parts)) for role, parts, alive in order.values() if alive]


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of the texts to learn from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, _ROLE)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = _BODY.match(formatted, head.end()) if head else None
        if not body or not formatted.startswith(END + "\n", body.end()):
            raise ValueError(f"not a formatted conversation at {at}")
        out.append((unescape(head[1]), unescape(body[0])))
        at = body.end() + len(END) + 1
    return out


def format_chats(events: DataFrame, learn: str = "assistant", max_records: int = 64) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<lo, hi>>) of every conversation.

    ``events`` has conv_id, seq (any sortable type, unique within a message's conversation), message (what
    tells messages apart), kind, role and text; other columns are ignored. Rows of a null conv_id form one
    conversation. Events of equal seq are ordered by message, kind and text. A conversation whose messages
    are all deleted gives an empty text. An empty log gives no rows.
    """
    kind = dict(events.dtypes)["conv_id"]
    log = events.select("conv_id", "seq", F.col("message").cast("string").alias("message"), "kind", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "text").drop("seq")
    out_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple] = []

        def flush():
            ids, texts, spans = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], out_type)], ["conv_id", "formatted", "loss_spans"])

        now, held, id_type, size = None, [], None, 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != now:
                    rows.append((now, *render(fold(held), learn)))
                    held, size = [], size + len(rows[-1][1])
                    if len(rows) >= max_records or size > 4_000_000:
                        yield flush()
                        size = 0
                now = conv
                held.append(tuple(event))
        if held:
            rows.append((now, *render(fold(held), learn)))
        if rows:
            yield flush()

    return log.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<lo:long,hi:long>>")


def as_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The event log of finished rows (conv_id, turn, role, text): each text arrives as deltas of ``delta``
    code points, and a draft that was cut short is regenerated first.

    Repeated rows are messages of their own. Rows of equal turn are ordered by role and text; null turns
    come first.
    """
    same = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_n"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = same.select("conv_id", "turn", "role", text.alias("text"), F.col("text").isNull().alias("_null"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
    n = F.ceil(F.length("text") / F.lit(delta)).cast("int")
    steps = F.concat(
        F.array(F.struct(F.lit(-2).alias("part"), F.lit("start").alias("kind"), F.lit("").alias("piece"))),
        F.array(F.struct(F.lit(-1).alias("part"), F.lit("delta").alias("kind"), F.substring("text", 1, 8).alias("piece"))),
        F.array(F.struct(F.lit(0).alias("part"), F.lit("regenerate").alias("kind"), F.lit("").alias("piece"))),
        F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("part"), F.lit("delta").alias("kind"), F.substring(F.col("text"), (k - 1) * delta + 1, F.lit(delta)).alias("piece")))).otherwise(F.array().cast("array<struct<part:int,kind:string,piece:string>>")),
    )
    digest = F.sha2("text", 256)
    rows = rows.select("conv_id", "turn", "role", "_copy", F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.coalesce("role", F.lit("")), F.substring("text", 1, 64), digest, "_null", "_copy").alias("message"), F.substring("text", 1, 64).alias("_head"), digest.alias("_digest"), F.explode(steps).alias("_s"))
    return rows.select(
        "conv_id",
        F.struct("turn", "role", "_head", "_digest", "_copy", F.col("_s.part")).alias("seq"),
        "message",
        F.col("_s.kind").alias("kind"),
        "role",
        F.col("_s.piece").alias("text"),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from the formatted text and its spans."""
    kind = dict(chats.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["lo"] : s["hi"]]) for s in spans)
                rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["conv_id", *"abcde"])

    out = chats.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, a long, b string, c long, d string, e long")
    return out.toDF("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
