"""Folding and matching of text in original UTF-16 coordinates."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _accents() -> tuple[str, str]:
    """Precomposed letters and their bases, by the rule of canonical decomposition."""
    pairs = []
    for code in (*range(0xC0, 0xD800), *range(0xE000, 0x30000)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache
def _undecided() -> str:
    """A character class of everything that ``folded`` compares otherwise than ``fold``: combining marks, characters
    that decompose beyond one letter (syllables, voiced kana), and those whose lower case depends on more."""
    table, ranges = dict(zip(*_accents(), strict=True)), []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):  # beyond it nothing folds
        c, low = chr(code), chr(code).lower()
        if c == low and unicodedata.is_normalized("NFD", c):
            continue
        same = len(low) == 1 and c != "Σ" and all(fold(x) == table.get(y, y) and fold(x, True) == table.get(x, x) for x, y in ((c, low), (low, low)))
        if not same and not unicodedata.category(c).startswith("M"):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    shown = lambda some: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in some)
    low, high = ([r for r in ranges if (r[0] < 0x300) == is_low] for is_low in (True, False))
    return rf"[{shown(low)}[[^\x00-\x{{2FF}}]&&[\p{{M}}{shown(high)}]]]"  # Latin letters need one comparison


def undecided(text: Column) -> Column:
    """Whether ``folded`` may differ from ``fold`` on a text."""
    return text.rlike(_undecided())


def folded(text: Column, case_sensitive: bool = False, diacritic_sensitive: bool = False) -> Column:
    """The text as it is compared, for texts that are not ``undecided``; its length stays the same."""
    out = text if case_sensitive else F.lower(text)
    return out if diacritic_sensitive else F.translate(out, *_accents())


def fold(text: str, case_sensitive: bool = False, diacritic_sensitive: bool = False) -> str:
    """A query as it is compared."""
    out = text if case_sensitive else text.replace("Σ", "σ").lower()  # whatever stands next to it
    if not diacritic_sensitive:
        out = "".join(c for c in unicodedata.normalize("NFD", out) if unicodedata.category(c) != "Mn")
    return out


def fold_clusters(text: str, case_sensitive: bool, diacritic_sensitive: bool) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters and its end the UTF-16 place in ``text`` where its
    cluster (a character with the combining marks after it) begins."""
    if text.isascii():
        return fold(text, case_sensitive, diacritic_sensitive), list(range(len(text) + 1))
    out, places, at, k = [], [], 0, 0
    while k < len(text):
        end = k + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        cluster = text[k:end]
        own = fold(cluster, case_sensitive, diacritic_sensitive)
        out.append(own)
        places += [at] * len(own)
        at += sum(2 if ord(c) > 0xFFFF else 1 for c in cluster)
        k = end
    places.append(at)
    return "".join(out), places


def find_matches(text: str, query: str, case_sensitive: bool = False, diacritic_sensitive: bool = False, limit: int | None = None) -> list[tuple[int, int]]:
    """Non-overlapping matches from left to right as UTF-16 ranges, on cluster boundaries.

    ``query`` is folded already.
    """
    hay, places = fold_clusters(text, case_sensitive, diacritic_sensitive)
    out, at, n = [], 0, len(query)
    while n and (limit is None or len(out) < limit):
        at = hay.find(query, at)
        if at < 0:
            break
        inside_start = at > 0 and places[at] == places[at - 1]
        inside_end = at + n < len(hay) and places[at + n] == places[at + n - 1]
        if inside_start or inside_end:
            at += 1
            continue
        out.append((places[at], places[at + n]))
        at += n
    return out


_LINE = str.maketrans("\n\r\t", "   ")


def snippet(text: str, lo: int, hi: int, reach: int) -> tuple[str, int, int]:
    """The surroundings of a UTF-16 range, and the range within them; halves of pairs and marks without
    their base are left out at the ends."""
    if text.isascii():
        a, b = max(0, lo - reach), min(len(text), hi + reach)
        return text[a:b].translate(_LINE), lo - a, hi - a
    raw = text.encode("utf-16-le", "surrogatepass")
    unit = lambda k: raw[2 * k] | raw[2 * k + 1] << 8
    size = len(raw) // 2
    inner = lambda k: 0 < k < size and (0xDC00 <= unit(k) < 0xE000 or unicodedata.combining(chr(unit(k))) > 0)
    a, b = max(0, lo - reach), min(size, hi + reach)
    while a < lo and inner(a):
        a += 1
    while b > hi and inner(b):
        b -= 1
    return raw[2 * a : 2 * b].decode("utf-16-le", "replace").translate(_LINE), lo - a, hi - a


def trimmed(query: str) -> str:
    return query.strip()


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def utf16_slice(text: Column, lo: Column, hi: Column) -> Column:
    """The text from UTF-16 place lo to hi; halves of pairs at its ends are left out."""
    raw = F.encode(text, "UTF-16BE")
    lead = lambda at: F.hex(F.substring(raw, (2 * at - 1).cast("int"), F.lit(1))).between("D8", "DB")  # noqa: E731  whether the unit before a place begins a pair
    a = F.greatest(lo, F.lit(0))
    first = a + F.when((a > 0) & lead(a), 1).otherwise(0)
    last = hi - F.when((hi > 0) & lead(hi), 1).otherwise(0)
    paired = F.decode(F.substring(raw, (2 * first + 1).cast("int"), F.greatest(2 * (last - first), F.lit(0)).cast("int")), "UTF-16BE")
    plain = F.substring(text, (a + 1).cast("int"), F.greatest(hi - a, F.lit(0)).cast("int"))
    return F.when(F.length(text) == utf16_length(text), plain).otherwise(paired)


def word_at(text: Column, offset: Column) -> Column:
    """The range (lo, hi) of the word that holds ``offset``, or else of the word with the nearest boundary,
    the later one on a tie; null without words. A word is a stretch of letters and digits."""
    pieces = F.split(text, r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])")
    ends = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("words")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            F.when(
                x.rlike(r"^[\p{L}\p{N}]"),
                F.array_append(acc["words"], F.struct(acc["at"].alias("lo"), (acc["at"] + F.length(F.regexp_extract(x, r"^[\p{L}\p{N}]+", 0))).alias("hi"))),
            ).otherwise(acc["words"]).alias("words"),
        ),
        lambda acc: acc["words"],
    )
    distance = lambda w: F.greatest(F.lit(0), w["lo"] - offset, offset - w["hi"])
    inside = lambda w: (offset >= w["lo"]) & (offset < w["hi"])
    ranked = F.transform(ends, lambda w: F.struct(F.when(inside(w), -1).otherwise(distance(w)).alias("d"), (-w["lo"]).alias("l"), w.alias("w")))
    return F.array_min(ranked)["w"]
