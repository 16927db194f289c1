"""Text runs of a page's content, and the fonts that decode them."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import add

from ..limits import GLYPHS_PER_PAGE
from .codecs import CodecError
from .cos import Damage, Name, Op, Reader, Stream
from .pdf import Document, Page

# Where the standard and the Windows encoding differ from Latin-1, and names of glyphs that
# aren't single characters.
STANDARD = {0x27: "’", 0x60: "‘"}
WINDOWS = dict(enumerate("€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ", 0x80))
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "quoteleft": "‘", "quoteright": "’",
    "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "germandbls": "ß", "fi": "ﬁ", "fl": "ﬂ", "Euro": "€",
}

# How names of glyphs call the marks of letters, marks by themselves, and letters and signs whose names
# follow no rule.
MARKS = {
    "GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla",
    "CARON": "caron", "MACRON": "macron", "BREVE": "breve", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut",
}
LONE = {
    "grave": "`", "acute": "´", "circumflex": "ˆ", "tilde": "˜", "dieresis": "¨", "ring": "˚", "cedilla": "¸", "caron": "ˇ", "macron": "¯", "breve": "˘", "ogonek": "˛",
    "dotaccent": "˙", "hungarumlaut": "˝", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "lslash": "ł", "Lslash": "Ł", "eth": "ð", "Eth": "Ð",
    "thorn": "þ", "Thorn": "Þ", "dotlessi": "ı", "dcroat": "đ", "Dcroat": "Đ", "hbar": "ħ", "Hbar": "Ħ", "kgreenlandic": "ĸ", "eng": "ŋ", "Eng": "Ŋ", "tbar": "ŧ", "Tbar": "Ŧ",
    "asciicircum": "^", "asciitilde": "~", "bar": "|", "braceleft": "{", "braceright": "}", "exclamdown": "¡", "questiondown": "¿", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "copyright": "©", "registered": "®", "trademark": "™", "ordfeminine": "ª", "ordmasculine": "º",
    "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "logicalnot": "¬", "degree": "°", "plusminus": "±", "mu": "µ",
    "paragraph": "¶", "periodcentered": "·", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "multiply": "×", "divide": "÷", "dagger": "†", "daggerdbl": "‡",
    "perthousand": "‰", "quotesinglbase": "‚", "quotedblbase": "„", "florin": "ƒ", "fraction": "⁄", "minus": "−", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "nbspace": "\u00a0",
    "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂",
    "summation": "∑", "product": "∏", "integral": "∫", "radical": "√", "approxequal": "≈", "lozenge": "◊", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓",
}


def _by_rule() -> dict[str, str]:
    """Names of letters with a mark (base letter, then mark), and of Greek letters, from the characters' names."""
    out = {}
    for c in map(chr, (*range(0xC0, 0x180), *range(0x218, 0x21C))):
        if (m := re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(c))) and m[3] in MARKS:
            out[(m[2] if m[1] == "CAPITAL" else m[2].lower()) + MARKS[m[3]]] = c
    for c in map(chr, range(0x391, 0x3CA)):
        if m := re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER ([A-Z]+)", unicodedata.name(c, "")):
            name = m[2].lower().replace("lamda", "lambda")
            out[name.capitalize() if m[1] == "CAPITAL" else name] = c
    return out


GLYPHS = _by_rule() | LONE | GLYPHS


def glyph_text(name: str) -> str:
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"
    return name if len(name) == 1 else "�"


def base_encoding(name: str | None) -> dict[int, str]:
    table = {c: chr(c) for c in range(32, 127)}
    if name == "WinAnsiEncoding":
        return table | {c: chr(c) for c in range(0xA0, 0x100)} | WINDOWS
    if name == "MacRomanEncoding":
        return table | {c: bytes([c]).decode("mac-roman") for c in range(128, 256)}
    return table | STANDARD


@dataclass
class UnicodeMap:
    """Code to text: single codes first, then the first range that holds the code."""

    single: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, bytes]] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> UnicodeMap:
        out, reader, held = cls(), Reader(data, 0, refs=False), []
        text = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) and len(b) > 1 else chr(b[0]) if b else ""
        while len(out.single) + len(out.ranges) < 262_144:
            try:
                v = reader.value()
            except Damage:
                break
            if type(v) is not Op:
                held.append(v)
                continue
            if v == "endbfchar":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out.single[int.from_bytes(a, "big")] = text(b)
            elif v == "endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    if isinstance(to, list):
                        out.single |= {lo + k: text(x) for k, x in enumerate(to[: hi - lo + 1]) if isinstance(x, bytes)}
                    elif isinstance(to, bytes) and lo <= hi:
                        out.ranges.append((lo, hi, to if len(to) > 1 else b"\0" + to))
            held = []
        return out

    def get(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        for lo, hi, to in self.ranges:
            if lo <= code <= hi:
                last = (int.from_bytes(to[-2:], "big") + code - lo) & 0xFFFF
                return (to[:-2] + last.to_bytes(2, "big")).decode("utf-16-be", "replace")
        return None


def _between(lo: bytes, hi: bytes) -> bytes:
    """A pattern (with DOTALL) of the byte strings from ``lo`` to ``hi``, which are as long."""
    one = lambda a, b: rb"[\x%02x-\x%02x]" % (a, b)
    if len(lo) == 1:
        return one(lo[0], hi[0])
    if lo[0] == hi[0]:
        return b"%s(?:%s)" % (one(lo[0], lo[0]), _between(lo[1:], hi[1:]))
    least, most, n = bytes(len(lo) - 1), b"\xff" * (len(lo) - 1), b"." * (len(lo) - 1)
    parts = [one(lo[0], lo[0]) + b"(?:" + _between(lo[1:], most) + b")", one(hi[0], hi[0]) + b"(?:" + _between(least, hi[1:]) + b")"]
    if hi[0] - lo[0] > 1:
        parts.append(one(lo[0] + 1, hi[0] - 1) + n)
    return b"|".join(parts)


@dataclass
class CidMap:
    """A font's own map of codes to glyph numbers, with the byte lengths its codespaces give."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # length, first, last
    single: dict[int, int] = field(default_factory=dict)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first, last, first glyph
    vertical: bool = False

    @classmethod
    def parse(cls, data: bytes) -> CidMap | None:
        """None without codespaces. Damaged and reversed entries are left out."""
        out, reader, held = cls(), Reader(data, 0, refs=False), []
        whole = lambda v: type(v) is int and v >= 0
        while reader.at < len(data) and len(out.single) + len(out.ranges) < 262_144:
            try:
                v = reader.value()
            except Damage:
                reader.at += 1
                continue
            if type(v) is not Op:
                held.append(v)
                continue
            step = {"endcodespacerange": 2, "endcidrange": 3, "endcidchar": 2}.get(v, 0)
            for k in range(0, len(held) - step + 1, step or 1) if step else ():
                a, b = held[k], held[k + 1]
                if not isinstance(a, bytes) or not (whole(b) if v == "endcidchar" else isinstance(b, bytes)):
                    continue
                lo = int.from_bytes(a, "big")
                if v == "endcidchar":
                    out.single[lo] = b
                elif lo <= (hi := int.from_bytes(b, "big")):
                    if v == "endcodespacerange":
                        out.spaces.append((len(a), lo, hi))
                    elif whole(held[k + 2]):
                        out.ranges.append((len(a), lo, hi, held[k + 2]))
            for name, mode in zip(held, held[1:], strict=False):
                if isinstance(name, Name) and name == "WMode" and type(mode) is int:
                    out.vertical = mode == 1
            held = []
        return out if out.spaces else None

    @cached_property
    def _cut(self) -> re.Pattern | None:
        """A pattern of the next code: codespaces by length, then any byte. None for very many codespaces."""
        parts = []
        for n in range(1, 5):
            merged: list[list[int]] = []
            for lo, hi in sorted((lo, min(hi, 256**n - 1)) for m, lo, hi in self.spaces if m == n):
                if merged and lo <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            parts += [_between(lo.to_bytes(n, "big"), hi.to_bytes(n, "big")) for lo, hi in merged if lo <= hi]
        return re.compile(b"|".join([*parts, b"."]), re.DOTALL) if len(parts) <= 512 else None

    def pieces(self, b: bytes) -> list[bytes]:
        """``b`` cut into codes: of the codespaces that hold the next bytes the shortest, else one byte."""
        if self._cut:
            return self._cut.findall(b)
        out, at = [], 0
        while at < len(b):
            for n in range(1, min(4, len(b) - at) + 1):
                code = int.from_bytes(b[at : at + n], "big")
                if any(m == n and lo <= code <= hi for m, lo, hi in self.spaces):
                    break
            else:
                n = 1
            out.append(b[at : at + n])
            at += n
        return out

    def codes(self, b: bytes):
        """(code, length) of the ``pieces``."""
        return ((int.from_bytes(x, "big"), len(x)) for x in self.pieces(b))

    def get(self, code: int, length: int) -> int | None:
        """A single entry first, then the first range of that length that holds the code."""
        if code in self.single:
            return self.single[code]
        return next((to + code - lo for n, lo, hi, to in self.ranges if n == length and lo <= code <= hi), None)


class _Learnt(dict):
    """Values by code, each asked of ``learn`` once. ``uneven``: whether a value that begins with a text had one of other
    than one UTF-16 unit."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.uneven = learn, False

    def __missing__(self, code):
        value = self[code] = self.learn(code)
        if type(value) is tuple and _units(value[0]) != 1:
            self.uneven = True
        return value


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass
class Font:
    """Decodes strings; the default is one byte a code, unknown text and width 500."""

    two_byte: bool = False
    unicode: UnicodeMap | None = None
    encoding: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 500.0
    ascent: float = 800.0
    descent: float = -200.0
    vertical: bool = False
    cids: CidMap | None = None
    pace: tuple | None = None

    def codes(self, b: bytes) -> list:
        """The codes of a string, which ``known`` knows."""
        if self.cids:
            return self.cids.pieces(b)
        if not self.two_byte:
            return list(b)
        return [*struct.unpack(f">{len(b) // 2}H", b[: len(b) & ~1]), *b[len(b) & ~1 :]]

    @cached_property
    def known(self) -> _Learnt:
        """(text, width in thousandths, whether it is a single-byte space) by code."""

        def learn(c):
            if isinstance(c, bytes):
                n, c = len(c), int.from_bytes(c, "big")
                text = self.unicode.get(c) if self.unicode else None
                return text if text is not None else "�", self.widths.get(self.cids.get(c, n), self.default_width), n == 1 and c == 32
            text = self.unicode.get(c) if self.unicode else None
            return text if text is not None else self.encoding.get(c, "�"), self.widths.get(c, self.default_width), c == 32 and not self.two_byte

        return _Learnt(learn)

    @cached_property
    def texts(self) -> _Learnt:
        return _Learnt(lambda c: self.known[c][0])

    @cached_property
    def units(self) -> _Learnt:
        """The UTF-16 units of the text by code."""
        return _Learnt(lambda c: _units(self.known[c][0]))

    @property
    def uneven(self) -> bool:
        """Whether a code learnt so far has a text of other than one unit."""
        return self.known.uneven

    def steps(self, size: float, char_space: float, word_space: float, stretch: float) -> _Learnt:
        """How far each code moves on; those of the last setting are kept."""
        key = size, char_space, word_space, stretch
        if self.pace is None or self.pace[0] != key:

            def learn(c):
                _, width, space = self.known[c]
                return (width / 1000 * size + char_space + (word_space if space else 0.0)) * stretch

            self.pace = key, _Learnt(learn)
        return self.pace[1]

    def glyphs(self, b: bytes):
        """(text, width in thousandths, whether it is a single-byte space) of each code."""
        return map(self.known.__getitem__, self.codes(b))


def load_font(doc: Document, spec) -> Font:
    """The font of a resource; whatever is missing or damaged falls back."""
    font, spec = Font(), doc.resolve(spec)
    if not isinstance(spec, dict):
        return font
    stream = doc.resolve(spec.get("ToUnicode"))
    if isinstance(stream, Stream):
        try:
            font.unicode = UnicodeMap.parse(doc.decoded(stream))
        except CodecError:
            doc.warnings.add("toUnicode")
    number = lambda v, d: float(v) if isinstance(v := doc.resolve(v), int | float) else d
    if spec.get("Subtype") == "Type0":
        font.two_byte, font.default_width = True, 1000.0
        encoding = doc.resolve(spec.get("Encoding"))
        if isinstance(encoding, Stream):
            try:
                font.cids = CidMap.parse(doc.decoded(encoding))
            except CodecError:
                doc.warnings.add("cidMap")
        font.vertical = font.cids.vertical if font.cids else str(encoding).endswith("-V")
        kids = doc.resolve(spec.get("DescendantFonts"))
        kid = doc.resolve(kids[0]) if isinstance(kids, list) and kids else None
        if isinstance(kid, dict):
            font.default_width = number(kid.get("DW"), 1000.0)
            _cid_widths(doc, font, doc.resolve(kid.get("W")))
            _descriptor(doc, font, kid, number)
        return font
    encoding, base = doc.resolve(spec.get("Encoding")), None
    if isinstance(encoding, dict):
        base = encoding.get("BaseEncoding")
    elif isinstance(encoding, Name):
        base = encoding
    font.encoding = base_encoding(base)
    code = 0
    for item in (doc.resolve(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
        if isinstance(item, int):
            code = item
        elif isinstance(item, Name):
            if 0 <= code < 256:
                font.encoding[code] = glyph_text(item)
            code += 1
    scale, matrix = 1.0, doc.resolve(spec.get("FontMatrix"))
    if spec.get("Subtype") == "Type3" and isinstance(matrix, list) and matrix and isinstance(matrix[0], int | float):
        scale = matrix[0] * 1000
    first, widths = doc.resolve(spec.get("FirstChar")), doc.resolve(spec.get("Widths"))
    if isinstance(first, int) and isinstance(widths, list):
        font.widths = {first + k: number(w, 0.0) * scale for k, w in enumerate(widths[:256])}
    _descriptor(doc, font, spec, number)
    return font


def _descriptor(doc: Document, font: Font, spec: dict, number) -> None:
    d = doc.resolve(spec.get("FontDescriptor"))
    if isinstance(d, dict):
        font.ascent, font.descent = number(d.get("Ascent"), 800.0), number(d.get("Descent"), -200.0)
        if not font.two_byte:
            font.default_width = number(d.get("MissingWidth"), 500.0)


def _cid_widths(doc: Document, font: Font, items) -> None:
    """Widths as ``first [w ...]`` or ``first last w``; later ones count."""
    items = [doc.resolve(x) for x in items[:4096]] if isinstance(items, list) else []
    k = 0
    while k + 1 < len(items):
        if isinstance(items[k + 1], list):
            if isinstance(items[k], int):
                font.widths |= {items[k] + j: float(w) for j, w in enumerate(items[k + 1]) if isinstance(w, int | float)}
            k += 2
        elif k + 2 < len(items):
            lo, hi, w = items[k : k + 3]
            if isinstance(lo, int) and isinstance(hi, int) and isinstance(w, int | float) and 0 <= hi - lo <= 65535:
                font.widths |= dict.fromkeys(range(lo, hi + 1), float(w))
            k += 3
        else:
            break


def times(m: tuple, n: tuple) -> tuple:
    """First ``m``, then ``n``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


@dataclass
class State:
    ctm: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Run:
    text: str
    advances: list[float]
    x: float
    y: float
    dx: float
    dy: float
    size: float
    invisible: bool
    vertical: bool
    quad: list[tuple[float, float]]


class Interpreter:
    """Runs a page's operators and keeps what it shows. It never fails: what can't be read is skipped."""

    def __init__(self, doc: Document):
        self.doc, self.runs, self.fonts, self.glyphs = doc, [], {}, 0

    def page(self, page: Page) -> list[Run]:
        self.execute(self.doc.contents(page), page.resources, State(), 0)
        return self.runs

    def execute(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        reader, args, stack = Reader(data, 0, refs=False), [], []
        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        while reader.at < len(data):
            try:
                v = reader.value()
            except Damage:
                if not data[reader.at :].strip():
                    break
                reader.at += 1
                continue
            if type(v) is not Op:
                args.append(v)
                del args[:-64]
                continue
            n = [float(x) for x in args if isinstance(x, int | float) and not isinstance(x, bool)]
            last = args[-1] if args else None
            if v == "q":
                if len(stack) < 256:
                    stack.append(State(**vars(state)))
            elif v == "Q":
                state = stack.pop() if stack else state
            elif v == "cm" and len(n) >= 6:
                state.ctm = times(tuple(n[-6:]), state.ctm)
            elif v == "BT":
                tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif v in ("Td", "TD") and len(n) >= 2:
                state.leading = -n[-1] if v == "TD" else state.leading
                tm = line = times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif v == "Tm" and len(n) >= 6:
                tm = line = tuple(n[-6:])
            elif v == "T*":
                tm = line = times((1, 0, 0, 1, 0, -state.leading), line)
            elif v in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr") and n:
                key = {"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise", "Tz": "stretch", "Tr": "mode"}[v]
                setattr(state, key, n[-1] / 100 if v == "Tz" else min(7, max(0, int(n[-1]))) if v == "Tr" else n[-1])
            elif v == "Tf" and len(args) >= 2 and n:
                state.font, state.size = self.font(resources, args[-2]), n[-1]
            elif v == "Tj" and isinstance(last, bytes):
                tm = self.show(last, state, tm)
            elif v in ("'", '"') and isinstance(last, bytes):
                if v == '"' and len(n) >= 2:
                    state.word_space, state.char_space = n[-2], n[-1]
                line = times((1, 0, 0, 1, 0, -state.leading), line)
                tm = self.show(last, state, line)
            elif v == "TJ" and isinstance(last, list):
                for item in last:
                    if isinstance(item, bytes):
                        tm = self.show(item, state, tm)
                    elif isinstance(item, int | float):
                        tm = times((1, 0, 0, 1, -item / 1000 * state.size * state.stretch, 0), tm)
            elif v == "Do" and isinstance(last, Name) and depth < 16:
                self.form(resources, last, state, depth)
            elif v == "BI":
                m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(data, reader.at)
                reader.at = m.end() if m else len(data)
            args = []

    def font(self, resources: dict, name) -> Font:
        table = self.doc.resolve(resources.get("Font"))
        spec = table.get(name) if isinstance(table, dict) else None
        key = spec if isinstance(spec, tuple) else (id(resources), name)
        if key not in self.fonts:
            self.fonts[key] = load_font(self.doc, spec)
        return self.fonts[key]

    def form(self, resources: dict, name: Name, state: State, depth: int) -> None:
        table = self.doc.resolve(resources.get("XObject"))
        form = self.doc.resolve(table.get(name)) if isinstance(table, dict) else None
        if not isinstance(form, Stream) or form.info.get("Subtype") != "Form":
            return
        try:
            body = self.doc.decoded(form)
        except CodecError:
            return
        inner, matrix = State(**vars(state)), self.doc.resolve(form.info.get("Matrix"))
        if isinstance(matrix, list) and len(matrix) == 6 and all(isinstance(x, int | float) for x in matrix):
            inner.ctm = times(tuple(map(float, matrix)), state.ctm)
        own = self.doc.resolve(form.info.get("Resources"))
        self.execute(body, own if isinstance(own, dict) else resources, inner, depth + 1)

    def show(self, b: bytes, state: State, tm: tuple) -> tuple:
        """One string is one run; returns the matrix behind it."""
        font = state.font or Font()
        codes = font.codes(b)[: GLYPHS_PER_PAGE - self.glyphs]
        self.glyphs += len(codes)
        advances = list(map(font.steps(state.size, state.char_space, state.word_space, state.stretch).__getitem__, codes))
        total = reduce(add, advances, 0.0)  # in turn: sum() rounds otherwise
        if font.uneven:
            advances = [x for step, n in zip(advances, map(font.units.__getitem__, codes), strict=True) for x in ([step] + [0.0] * (n - 1) if n else [])]
        m = times(tm, state.ctm)
        scale = math.hypot(m[0], m[1])
        corner = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
        up, down = font.ascent / 1000 * state.size + state.rise, font.descent / 1000 * state.size + state.rise
        quad = [corner(0, down), corner(total, down), corner(total, up), corner(0, up)]
        x, y = corner(0, state.rise)
        values = [x, y, *m[:2], scale, total, *(v for p in quad for v in p)]
        if codes and all(math.isfinite(v) for v in values):
            size = abs(state.size) * math.hypot(m[2], m[3])
            self.runs.append(Run("".join(map(font.texts.__getitem__, codes)), advances if scale == 1.0 else [a * scale for a in advances], x, y, m[0], m[1], size, state.mode in (3, 7), font.vertical, quad))
        move = (0.0, -total) if font.vertical else (total, 0.0)
        return times((1, 0, 0, 1, *move), tm)
