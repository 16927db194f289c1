"""Objects of the portable document format: lexing and parsing, without Spark.

Values: None, bool, int, float, ``Name``, bytes (strings), list, dict, ``Ref`` and ``Stream``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from ..limits import NESTING


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Op(str):
    """An operator or any other bare word."""

    __slots__ = ()


@dataclass
class Stream:
    info: dict
    raw: bytes


class Damage(ValueError):
    """Bytes that are no object."""


@dataclass
class Warnings:
    """What was repaired or skipped, as (code, message)."""

    found: list[tuple[str, str]] = field(default_factory=list)

    def add(self, code: str, message: str = "") -> None:
        if len(self.found) < 1000:
            self.found.append((code, message))


_TOKEN = re.compile(
    rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<)|(?P<close>>>)|(?P<hex><[^>]*>?)|(?P<str>\()|(?P<mark>[\[\]{}])|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+))"
)
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPE = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
_WORDS = {b"true": True, b"false": False, b"null": None}
_MARK = object()


def _number(b: bytes):
    if b.isdigit() or b[:1] in b"+-" and b[1:].isdigit():
        value = int(b)
        return value if -(1 << 63) <= value < 1 << 63 else float(value)
    return float(b)


def _name(b: bytes) -> Name:
    if b"#" in b:
        b = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), b)
    return Name(b[1:].decode("utf-8", "surrogateescape") if b.isascii() else b[1:].decode("latin-1"))


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses; ``at`` is behind the first."""
    out, depth, n = bytearray(), 1, len(data)
    while at < n:
        c = data[at]
        at += 1
        if c == 0x5C and at < n:
            c = data[at]
            at += 1
            if c in _ESCAPE:
                out.append(_ESCAPE[c])
            elif 48 <= c <= 55:
                value, k = c - 48, 1
                while k < 3 and at < n and 48 <= data[at] <= 55:
                    value, at, k = value * 8 + data[at] - 48, at + 1, k + 1
                out.append(value & 255)
            elif c == 13:
                at += at < n and data[at] == 10
            elif c != 10:
                out.append(c)
            continue
        if c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return bytes(out), at
        elif c == 13:
            at += at < n and data[at] == 10
            c = 10
        out.append(c)
    raise Damage("string without end")


class Reader:
    """Reads values one after another. ``refs``: whether two numbers and R are a reference."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def token(self):
        """The next value or mark; None at the end as (False, None)."""
        m = _TOKEN.match(self.data, self.at)
        if not m or m.lastgroup is None:
            if not self.data[self.at :].strip(b"\0\t\n\f\r "):
                return False, None
            raise Damage(f"no token at {self.at}")
        kind, text = m.lastgroup, m[m.lastgroup]
        self.at = m.end()
        if kind == "num":
            value = _number(text)
            if self.refs and type(value) is int and value >= 0 and (r := _REF.match(self.data, self.at)):
                self.at = r.end()
                return True, Ref(value, int(r[1]))
            return True, value
        if kind == "name":
            return True, _name(text)
        if kind == "str":
            value, self.at = _literal(self.data, self.at)
            return True, value
        if kind == "hex":
            digits = text[1:].rstrip(b">").translate(None, b"\0\t\n\f\r ")
            try:
                return True, bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
            except ValueError as e:
                raise Damage("hex string") from e
        if kind == "word" and text in _WORDS:
            return True, _WORDS[text]
        return True, Op(text.decode("latin-1"))

    def value(self) -> Any:
        """The next whole value; an ``Op`` for words. Containers may nest up to a cap."""
        stack: list[tuple[str, list]] = []
        while True:
            ok, v = self.token()
            if not ok:
                raise Damage("end of data")
            if type(v) is Op and v in ("[", "<<"):
                if len(stack) >= NESTING:
                    raise Damage("nesting")
                stack.append((v, []))
                continue
            if type(v) is Op and v in ("]", ">>"):
                if not stack or (stack[-1][0] == "[") != (v == "]"):
                    raise Damage("unbalanced")
                kind, items = stack.pop()
                v = items if kind == "[" else {k: x for k, x in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
            elif type(v) is Op and stack:
                if v in ("endobj", "stream", "endstream", "obj"):
                    raise Damage("container without end")
                continue
            if not stack:
                return v
            stack[-1][1].append(v)


_HEADER = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj")
_STREAM = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*stream(\r\n|\n|\r)?")
_END = re.compile(rb"[\0\t\n\f\r ]*endstream")


def indirect(data: bytes, at: int, length_of, warnings: Warnings) -> tuple[int, int, Any]:
    """(number, generation, value) of the object that begins at ``at``.

    A stream's /Length counts if ``endstream`` follows there, else the next ``endstream`` ends it.
    ``length_of`` resolves a reference to a length.
    """
    m = _HEADER.match(data, at)
    if not m:
        raise Damage("no object header")
    reader = Reader(data, m.end())
    value = reader.value()
    if type(value) is Op:
        value = None
    if isinstance(value, dict) and (s := _STREAM.match(data, reader.at)):
        start, length = s.end(), value.get("Length")
        if isinstance(length, Ref):
            length = length_of(length)
        if not isinstance(length, int) or length < 0 or not _END.match(data, start + length):
            end = data.find(b"endstream", start)
            end = len(data) if end < 0 else end
            warnings.add("streamLength", f"object {m[1].decode()}")
            body = data[start:end]
            body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
        else:
            body = data[start : start + length]
        value = Stream(value, body)
    return int(m[1]), int(m[2]), value
