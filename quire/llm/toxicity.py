"""Toxicity scores on text that a noisy-channel decoder has restored.

A token that holds signs, long repetitions or single letters spread by spaces, dots or dashes is a
character lattice: each place may stand for itself or for the letters it imitates, a repetition for one
or two letters, and a gap between spread letters for nothing or for the end of a word. A Viterbi search
under a character trigram model picks the likeliest words. The model counts words and numbers of all
documents, so that a number is read as itself where that is likelier. Restored words and their beginnings
are weighed by how much more often labelled toxic documents hold them than others, and a logistic model
turns a document's strongest weights into a probability. Words spread in pieces of two or more letters
are not joined.

The classifier is fitted on a bounded, hash-ordered sample of labelled rows (``sample``); near copies count
once in it, one part weighs the words and the other fits the logistic model. Scoring is one pass over
all documents without a shuffle: the broadcast model has at most ``KEPT`` x ``sample`` weights and
``trigrams`` counts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, tidy, written

SAMPLE = 20_000
#: Weighty features kept, for each row of the sample.
KEPT = 4
#: Trigrams of the character model, the most frequent of all documents: the bound of its broadcast.
TRIGRAMS = 400_000
#: Distinct tokens or trigrams that a task gathers before it hands them on.
HELD = 200_000
LEAST_SUPPORT = 4

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
_EDGE = ".,;:?\"'()[]{}<>»«…-–—_*`~#"
_GAP = "[ \\t._*-]{1,3}"
_UNIT = r"(?:[A-Za-z0-9@$!+|(<]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
_SPREAD = re.compile(rf"(?<![^\x20\x09-\x0D\"'(]){_UNIT}(?:{_GAP}{_UNIT}){{2,}}(?![^\x20\x09-\x0D\"').,;:?!])".encode("latin-1"))
_GAPS = re.compile(f"({_GAP})")
_REPEAT = re.compile(r"(.)\1\1")
START, END = "\x02", "\x03"


@dataclass
class CharModel:
    """Character trigrams of words, with smoothing; words are framed by two ``START`` and an ``END``."""

    three: dict[str, int] = field(default_factory=dict)
    two: dict[str, int] = field(default_factory=dict)
    letters: int = 1

    @classmethod
    def of(cls, words: dict[str, int]) -> CharModel:
        return cls.counted(trigrams(words.items()))

    @classmethod
    def counted(cls, three: dict[str, int]) -> CharModel:
        two = Counter()
        for g, n in three.items():
            two[g[:2]] += n
        return cls(dict(three), dict(two), len({g[2] for g in three} | {END}))

    def cost(self, context: str, c: str) -> float:
        return -math.log((self.three.get(context + c, 0) + 0.1) / (self.two.get(context, 0) + 0.1 * self.letters))


def trigrams(words) -> Counter:
    out = Counter()
    for w, n in words:
        framed = START + START + w + END
        for i in range(len(framed) - 2):
            out[framed[i : i + 3]] += n
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a token: (letters, channel cost). A run of three or more equal signs is
    one place, read as one or two letters. Among letters a sign rarely stands for itself, alone it may."""
    out, mixed = [], any(map(str.isalpha, token))
    for c, run in itertools.groupby(token):
        n = len(list(run))
        reads = [(c, 0.7 if mixed and c in LEET else 0.05)] + [(x, 0.7) for x in LEET.get(c, "")]
        if n >= 3:
            out.append([(x, p) for x, p in reads] + [(x + x, p + 0.5) for x, p in reads])
        else:
            out += [reads] * n
    return out


def spread(parts: list[str]) -> list[list[tuple[str, float]]]:
    """Readings of letters (at even places of ``parts``) spread by gaps: a gap joins its letters or ends a
    word, which is likelier where it is wider than the narrowest."""
    least = min(map(len, parts[1::2]))
    joins = [[("", 0.1), (" ", 1.0)], [("", 2.0), (" ", 0.1)]]
    mixed = any(map(str.isalpha, parts[::2]))
    out = []
    for k, x in enumerate(parts):
        if k % 2:
            out.append(joins[len(x) > least])
        else:
            out.append([(x, 0.7 if mixed and x in LEET else 0.05)] + [(y, 0.7) for y in LEET.get(x, "")])
    return out


def viterbi(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The reading of least cost under the channel and the character model, a space where a word ends. Ties
    go to the first reading."""
    best = {START + START: (0.0, None)}
    for reads in places:
        now: dict[str, tuple[float, tuple]] = {}
        for context, (cost, path) in best.items():
            for letters, paid in reads:
                total, state = cost + paid, context
                for c in letters:
                    if c == " ":
                        total, state = total + model.cost(state, END), START + START
                    else:
                        total, state = total + model.cost(state, c), state[1] + c
                if state not in now or total < now[state][0]:
                    now[state] = (total, (path, letters))
        best = now
    context = min(best, key=lambda k: best[k][0] + model.cost(k, END))
    path = best[context][1]
    letters = []
    while path:
        path, x = path
        letters.append(x)
    return "".join(reversed(letters))


def odd(word: str) -> bool:
    """Whether a word is worth decoding: it holds signs, or a repetition."""
    return any(c in LEET for c in word) or bool(_REPEAT.search(word))


def bare(token: bytes) -> str:
    """A token in lower case and without punctuation at its ends."""
    return str(token, "utf-8", "replace").lower().strip(_EDGE).rstrip("!")


def restore(token: bytes, model: CharModel) -> str:
    """The word that a token stands for, or the words of a spread run, with one space between."""
    word = bare(token)
    if len(word) < 2:
        return word
    if word[1] in " \t._*-":
        parts = _GAPS.split(word)
        if len(parts) >= 5 and all(len(x) == 1 and (x.isalnum() or x in LEET) for x in parts[::2]):
            return viterbi(spread(parts), model)
    return viterbi(lattice(word), model) if odd(word) else word


def tokens(text: bytes) -> set[bytes]:
    """The distinct tokens of a text, and runs of single letters spread by spaces, dots or dashes."""
    out = set(text.split())
    out.update(m[0] for m in _SPREAD.finditer(text))
    return out


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)] if word else []


@dataclass
class Model:
    chars: CharModel = field(default_factory=CharModel)
    weights: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)

    def weigh(self, token: bytes) -> tuple[tuple[str, float], ...]:
        """A token's restored words of positive weight, with their weights."""
        get = self.weights.get
        words = ((w, max((get(f, 0.0) for f in features(w)), default=0.0)) for w in restore(token, self.chars).split(" "))
        return tuple(x for x in words if x[1] > 0)

    def score(self, stats: tuple[float, ...]) -> float:
        z = self.coef[0] + sum(a * b for a, b in zip(self.coef[1:], stats, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class Scorer:
    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit, self.memo = model, limit, {}

    def stats(self, text: bytes) -> tuple[float, float, float]:
        """The largest weight, the sum of the three largest and the log of the number of weighty words."""
        memo, found = self.memo, {}
        if len(memo) > self.limit:
            memo.clear()
        for t in tokens(text):
            hit = memo.get(t)
            if hit is None:
                hit = self.model.weigh(t)
                if len(t) < 200:
                    memo[t] = hit
            if hit:
                found.update(hit)
        top = sorted(found.values(), reverse=True)
        return (top[0] if top else 0.0, sum(top[:3]), math.log1p(len(top)))


def _emit(batch_rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*batch_rows, strict=True), fields, strict=True)], [n for n, _ in fields]) if batch_rows else None


def _signatures(text: bytes) -> list[int]:
    """Four minimum hashes over five-word shingles; near copies share some."""
    words = text.lower().split()
    shingles = {xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
    h = np.fromiter(shingles, np.uint64, len(shingles))
    return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def char_model(docs: DataFrame, text_col: str = "text", most: int = TRIGRAMS) -> CharModel:
    """Trigrams of the words of letters and the numbers of all documents. Tasks count them first, so that
    a shuffle moves no tokens; the driver receives the ``most`` most frequent ones."""

    def count(batches):
        seen, found = Counter(), Counter()

        def settle():
            words = ((bare(t), n) for t, n in seen.items())
            found.update(trigrams((w, n) for w, n in words if w.isalpha() or any(map(str.isdigit, w)) and not any(map(str.isalpha, w))))
            seen.clear()

        def rows():
            items = list(found.items())
            found.clear()
            for k in range(0, len(items), 50_000):
                yield _emit(items[k : k + 50_000], [("g", pa.string()), ("n", pa.int64())])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(set(x.split()))
                if len(seen) > HELD:
                    settle()
                if len(found) > HELD:
                    yield from rows()
        settle()
        yield from rows()

    counted = docs.select(raw_text(text_col).alias("_text")).mapInArrow(tidy(count), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel.counted({r.g: r.n for r in counted.orderBy(F.desc("n"), "g").limit(most).collect()})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = TRIGRAMS) -> Model:
    """Fits the classifier on at most ``sample`` labelled rows, the first by a hash of their id. Rows without a
    label, an id or a document are left out; without both labels the model gives every text one score. Of
    an id with several labels the greatest counts, of one with several texts the least. The character model
    counts all rows of ``docs``, each distinct token of a text once; its ``most`` most frequent trigrams and
    ``KEPT`` x ``sample`` features of the greatest weights are kept."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), raw_text(text_col).alias("_text"))
    labelled = texts.join(F.broadcast(chosen), "_id")  # at most ``sample`` ids
    rows = written(labelled.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y")), "labelled")

    def sign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signatures(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["_id", "_s"])

    kind = dict(rows.dtypes)["_id"]
    seen, once = set(), []
    for r in sorted(rows.select("_id", "_text").mapInArrow(tidy(sign), f"_id {kind}, _s array<long>").collect(), key=lambda r: r._id):
        if not any((k, s) in seen for k, s in enumerate(r._s)):
            once.append((r._id,))
        seen.update(enumerate(r._s))
    if not once:
        return Model()
    spark = docs.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(once, f"_id {kind}")), "_id").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)) == 0)

    chars = char_model(docs, text_col, most)
    shared = spark.sparkContext.broadcast(chars)

    def count_features(batches):
        memo: dict[bytes, list[str]] = {}
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        size = [0, 0]
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for t in tokens(x):
                    if t not in memo:
                        memo[t] = [f for w in restore(t, shared.value).split(" ") for f in features(w)]
                    own.update(memo[t])
                for f in own:
                    counts[f][y] += 1
                size[y] += 1
        items = [("", *size)] + [(f, *n) for f, n in counts.items()]
        for k in range(0, len(items), 50_000):
            yield _emit(items[k : k + 50_000], [("f", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])

    found = rows.where("not _part").select("_text", "_y").mapInArrow(tidy(count_features), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = written(found, "features")
    total = found.where("f = ''").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    least = F.col("n1") - F.sqrt(F.col("n1").cast("double"))  # a cautious count of toxic documents
    weight = F.log((least + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    top = found.where(f"f <> '' and n1 >= {LEAST_SUPPORT}").withColumn("w", weight).where("w > 1")
    model = Model(chars, {r.f: r.w for r in top.orderBy(F.desc("w"), "f").limit(KEPT * sample).collect()})
    model_b = spark.sparkContext.broadcast(model)

    def measure(batches):
        scorer = Scorer(model_b.value)
        for batch in batches:
            stats = [scorer.stats(x) for x in batch.column(0).to_pylist()]
            if stats:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*stats, strict=True)] + [batch.column(1)], ["a", "b", "c", "_y"])

    seen_stats = np.array([tuple(map(float, r)) for r in rows.where("_part").select("_text", "_y").mapInArrow(tidy(measure), "a double, b double, c double, _y int").collect()]).reshape(-1, 4)
    model.coef = logistic(seen_stats[:, :3], seen_stats[:, 3])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Coefficients (intercept first) of a ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return (-2.0 if not len(y) or y.max() == 0 else 2.0, *([0.0] * x.shape[1]))
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        r = ridge * np.r_[0.001, np.ones(len(w) - 1)]
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(r) * 10 + 1e-9 * np.eye(len(w)), a.T @ (y - p) - r * 10 * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score double from 0 to 1): one row per input row, whatever it holds. Null and empty
    texts get the score of a text without weighty words. Repeated rows score alike."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [shared.value.score(scorer.stats(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "_s"])

    return docs.select(F.col(id_col).alias("_id"), raw_text(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, _s double").toDF(id_col, "score")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
