"""Tolerant reading of whole documents: sections, recovery, pages, metadata, outlines and text runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.parsers import expat

from ..limits import CONTENT_BYTES, OUTLINE_DEPTH, OUTLINE_ITEMS, PAGES, REFERENCE_HOPS, SECTIONS, TREE_DEPTH
from .codecs import CodecError, decode, stages
from .cos import Damage, Op, Reader, Ref, Stream, Warnings, indirect


class CannotOpen(ValueError):
    """``status``: notAPDF, encrypted, damaged."""

    def __init__(self, status: str, detail: str = ""):
        super().__init__(detail or status)
        self.status, self.detail = status, detail


@dataclass
class Page:
    number: int
    media: tuple
    crop: tuple
    rotate: int
    resources: dict
    contents: object


_DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
_VERSION = re.compile(rb"%PDF-(\d{1,2})\.(\d{1,2})(?!\d)")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
_ROW = re.compile(rb"[ \t]*(\d{10})[ \t](\d{5})[ \t]([nf])[ \t\r\n]*")


@dataclass
class Document:
    data: bytes
    bias: int = 0
    version: tuple[int, int] = (1, 4)
    trailer: dict = field(default_factory=dict)
    xref: dict = field(default_factory=dict)  # number: ("u", offset, gen), ("c", container, index) or ("f",)
    warnings: Warnings = field(default_factory=Warnings)
    decrypt: Callable[[bytes], bytes] | None = None  # of a stream's bytes, before its filters

    def __post_init__(self):
        self._objects, self._busy, self._containers = {}, set(), {}

    # opening

    @classmethod
    def open(cls, data: bytes, decrypt: Callable[[bytes], bytes] | None = None) -> Document:
        at = data[:1024].find(b"%PDF-")
        if at < 0:
            raise CannotOpen("notAPDF")
        self = cls(data, bias=at, decrypt=decrypt)
        if at:
            self.warnings.add("headerOffset", str(at))
        if m := _VERSION.match(data, at):
            self.version = int(m[1]), int(m[2])
        else:
            self.warnings.add("version")
        if b"%%EOF" not in data[-1024:]:
            self.warnings.add("endMark")
        starts = re.findall(rb"startxref[\0\t\n\f\r ]*(\d{1,18})", data[-1024:])
        ok = False
        if starts:
            try:
                self._chain(int(starts[-1]))
                ok = self._root() is not None
            except (Damage, ValueError, IndexError, KeyError, TypeError) as e:
                self.warnings.add("sections", str(e))
        if not ok:
            self._recover()
        if self.trailer.get("Encrypt") is not None:
            info = self.resolve(self.trailer["Encrypt"])
            raise CannotOpen("encrypted", str(info.get("Filter", "")) if isinstance(info, dict) else "")
        if self._root() is None:
            raise CannotOpen("damaged", "no catalog")
        return self

    def _root(self) -> dict | None:
        root = self.resolve(self.trailer.get("Root"))
        return root if isinstance(root, dict) and root.get("Type", "Catalog") == "Catalog" else None

    def _chain(self, start: int) -> None:
        """Sections from the newest on; an entry or trailer key that is known stays."""
        seen, todo, shift = set(), [start], 0
        while todo and len(seen) < SECTIONS:
            at = todo.pop(0)
            if at in seen:
                self.warnings.add("sectionCycle")
                continue
            seen.add(at)
            try:
                try:
                    rows, trailer = self._section(at + shift)
                except Damage:
                    if not self.bias or shift:
                        raise
                    rows, trailer = self._section(at + self.bias)
                    shift = self.bias
            except Damage:
                if len(seen) == 1:
                    raise
                self.warnings.add("section", str(at))
                continue
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int):
                try:
                    self._merge(self._section(hybrid + shift)[0], {}, shift)
                except Damage:
                    self.warnings.add("hybrid")
            self._merge(rows, trailer, shift)
            if isinstance(trailer.get("Prev"), int):
                todo.append(trailer["Prev"])

    def _merge(self, rows: dict, trailer: dict, shift: int) -> None:
        for num, entry in rows.items():
            if num and num not in self.xref:
                if entry[0] == "u":
                    if not 0 <= entry[1] + shift < len(self.data):
                        self.warnings.add("entryOffset", str(num))
                        continue
                    entry = ("u", entry[1] + shift, entry[2])
                self.xref[num] = entry
        for k, v in trailer.items():
            self.trailer.setdefault(k, v)

    def _section(self, at: int) -> tuple[dict, dict]:
        head = re.compile(rb"[\0\t\n\f\r ]*xref[\0\t\n\f\r ]*").match(self.data, at)
        return self._table(head.end()) if head else self._stream_section(at)

    def _table(self, at: int) -> tuple[dict, dict]:
        rows, sub = {}, re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ \t]+(\d{1,10})[ \t]*[\r\n]*")
        while m := sub.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            for k in range(count):
                row = _ROW.match(self.data, at)
                if not row:
                    raise Damage("section row")
                if row.end() - at != 20:
                    self.warnings.add("rowWidth")
                at = row.end()
                rows.setdefault(first + k, ("u", int(row[1]), int(row[2])) if row[3] == b"n" else ("f",))
        m = re.compile(rb"[\0\t\n\f\r ]*trailer").match(self.data, at)
        if not m:
            raise Damage("no trailer")
        trailer = Reader(self.data, m.end()).value()
        if not isinstance(trailer, dict):
            raise Damage("trailer")
        return rows, trailer

    def _stream_section(self, at: int) -> tuple[dict, dict]:
        if at < 0 or at >= len(self.data):
            raise Damage("section offset")
        _, _, value = indirect(self.data, at, lambda r: None, self.warnings)
        if not isinstance(value, Stream) or value.info.get("Type") != "XRef":
            raise Damage("no section")
        info = value.info
        widths = info.get("W")
        if not (isinstance(widths, list) and len(widths) >= 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths[:3]) and sum(widths[:3])):
            raise Damage("widths")
        a, b, c = widths[:3]
        body, rows = self.decoded(value), {}
        index = info.get("Index")
        index = index if isinstance(index, list) and all(isinstance(x, int) for x in index) else [0, info.get("Size") if isinstance(info.get("Size"), int) else 0]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for k in range(max(0, count)):
                row = body[at : at + a + b + c]
                if len(row) < a + b + c:
                    self.warnings.add("sectionShort")
                    return rows, info
                at += a + b + c
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                if kind in (0, 1, 2):
                    rows.setdefault(first + k, (("f",), ("u", x, y), ("c", x, y))[kind])
        return rows, info

    def _recover(self) -> None:
        """Objects by a scan of the whole file: the one at the greatest offset of each number counts."""
        self.warnings.add("recovered")
        self.xref, old = {}, self.trailer
        self.trailer = {k: v for k, v in old.items() if k in ("Encrypt", "ID", "Info")}
        self._objects.clear()
        self._containers.clear()
        for m in _OBJECT.finditer(self.data):
            self.xref[int(m[1])] = ("u", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Reader(self.data, m.end()).value()
            except Damage:
                continue
            if isinstance(t, dict):
                self.trailer |= t
        top, by_place = dict(self.xref), sorted(self.xref.items(), key=lambda kv: kv[1][1])
        for num, _ in by_place:
            value = self.get(Ref(num, 0))
            if isinstance(value, Stream) and value.info.get("Type") == "ObjStm":
                for k, (inner, _) in enumerate(self._container(num)):
                    if inner not in top:
                        self.xref[inner] = ("c", num, k)
                        self._objects.pop(inner, None)
            elif isinstance(value, Stream) and value.info.get("Type") == "XRef":
                for k in ("Root", "Info", "Encrypt", "ID"):
                    if k in value.info:
                        self.trailer[k] = value.info[k]
        if self._root() is None:
            for num in sorted(self.xref, key=lambda n: self.xref[n][1], reverse=True):
                value = self.get(Ref(num, 0))
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
                    break

    # objects

    def get(self, ref: Ref):
        """The object of a reference, without following further ones; None for what is missing or damaged."""
        num = ref.num
        if num in self._objects:
            return self._objects[num]
        if num in self._busy:
            return None
        entry, value = self.xref.get(num), None
        self._busy.add(num)
        try:
            if entry and entry[0] == "u":
                found, _, v = indirect(self.data, entry[1], self._length, self.warnings)
                value = v if found == num else None
            elif entry and entry[0] == "c":
                box = self.xref.get(entry[1])
                members = self._container(entry[1]) if box and box[0] == "u" else []
                if entry[2] < len(members) and members[entry[2]][0] == num:
                    value = members[entry[2]][1]
        except (Damage, CodecError, RecursionError) as e:
            self.warnings.add("object", f"{num}: {e}")
        finally:
            self._busy.discard(num)
        self._objects[num] = value
        return value

    def _length(self, ref: Ref):
        return self.get(ref)

    def resolve(self, value):
        for _ in range(REFERENCE_HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.get(value)
        return None

    def decoded(self, stream: Stream) -> bytes:
        names, own = self.resolve(stream.info.get("Filter")), self.resolve(stream.info.get("DecodeParms"))
        names = [self.resolve(x) for x in names] if isinstance(names, list) else names
        own = [self.resolve(x) for x in own] if isinstance(own, list) else own
        return decode(self.decrypt(stream.raw) if self.decrypt else stream.raw, stages(names, own))

    def _container(self, num: int) -> list:
        """(number, value) of the members of an object stream; members out of range are left out."""
        if num not in self._containers:
            self._containers[num] = out = []
            box = self.get(Ref(num, 0))
            if isinstance(box, Stream):
                try:
                    body = self.decoded(box)
                except CodecError:
                    self.warnings.add("objectStream", str(num))
                    return out
                n, first = self.resolve(box.info.get("N")), self.resolve(box.info.get("First"))
                if isinstance(n, int) and isinstance(first, int) and 0 <= n <= 100_000:
                    heads = Reader(body[:first], 0, refs=False)
                    try:
                        pairs = [(heads.token()[1], heads.token()[1]) for _ in range(n)]
                    except Damage:
                        pairs = []
                    for inner, at in pairs:
                        if not isinstance(inner, int) or not isinstance(at, int) or not 0 <= first + at < len(body):
                            self.warnings.add("member", str(num))
                            continue
                        try:
                            value = Reader(body, first + at).value()
                        except Damage:
                            value = None
                        out.append((inner, None if type(value) is Op else value))
        return self._containers[num]

    # pages

    def pages(self) -> list[Page]:
        """The leaves of the page tree in order, with what they inherit."""
        root = self._root()
        if root is None:
            return []
        out, seen = [], set()
        stack = [(root.get("Pages"), {}, 0)]
        while stack and len(out) < PAGES:
            ref, above, depth = stack.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict) or depth > TREE_DEPTH:
                self.warnings.add("pageNode")
                continue
            own = above | {k: v for k in ("MediaBox", "CropBox", "Rotate", "Resources") if (v := self.resolve(node.get(k))) is not None}
            kids = self.resolve(node.get("Kids"))
            if node.get("Type") == "Pages" or node.get("Type") != "Page" and kids is not None:
                for kid in reversed(kids if isinstance(kids, list) else []):
                    if isinstance(kid, Ref):
                        if kid.num in seen:
                            self.warnings.add("repeatedKid", str(kid.num))
                            continue
                        seen.add(kid.num)
                    stack.append((kid, own, depth + 1))
                continue
            media = self._box(own.get("MediaBox")) or _DEFAULT_BOX
            crop = _meet(self._box(own.get("CropBox")) or media, media) or media
            turn = own.get("Rotate", 0)
            turn = round(turn) if isinstance(turn, int | float) and not isinstance(turn, bool) and abs(turn) < 1e9 else 0
            resources = own.get("Resources")
            out.append(Page(ref.num if isinstance(ref, Ref) else -1, media, crop, turn % 360 if turn % 90 == 0 else 0, resources if isinstance(resources, dict) else {}, node.get("Contents")))
        return out

    def _box(self, value) -> tuple | None:
        v = [self.resolve(x) for x in value] if isinstance(value, list) and len(value) >= 4 else []
        if len(v) < 4 or not all(isinstance(x, int | float) and abs(x) < 1e12 for x in v[:4]):
            return None
        x0, x1, y0, y1 = min(v[0], v[2]), max(v[0], v[2]), min(v[1], v[3]), max(v[1], v[3])
        return (float(x0), float(y0), float(x1), float(y1)) if x1 > x0 and y1 > y0 else None

    def contents(self, page: Page) -> bytes:
        """The page's content, its parts joined by spaces and cut at ``CONTENT_BYTES``. Parts that are damaged are left
        out; a filter that isn't supported fails the page with ``CodecError``."""
        value = self.resolve(page.contents)
        out, left = [], CONTENT_BYTES + 1
        for part in value if isinstance(value, list) else [value]:
            if left <= 1:
                break
            stream = self.resolve(part)
            if isinstance(stream, Stream):
                try:
                    out.append(self.decoded(stream)[: left - 1])
                    left -= len(out[-1]) + 1
                except CodecError as e:
                    if e.code == "unsupportedFilter":
                        raise
                    self.warnings.add("contents", e.code)
        return b" ".join(out)

    # metadata and outline

    def metadata(self) -> dict:
        info, xmp = self.resolve(self.trailer.get("Info")), {}
        info = info if isinstance(info, dict) else {}
        root = self._root() or {}
        packet = self.resolve(root.get("Metadata"))
        if isinstance(packet, Stream):
            try:
                xmp = parse_xmp(self.decoded(packet))
            except CodecError:
                self.warnings.add("xmp")
        keys = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "modification_date": "ModDate"}
        own = {k: self.resolve(info.get(v)) for k, v in keys.items()}
        out = {k: text_string(v) if isinstance(v, bytes) else xmp.get(k) for k, v in own.items()}
        version = self.version
        if re.fullmatch(r"\d{1,2}\.\d{1,2}", str(root.get("Version", ""))):
            version = max(version, tuple(map(int, root["Version"].split("."))))
        return out | {"pdf_version": "{}.{}".format(*version)}

    def outline(self) -> list[tuple[int, str, int | None]]:
        """(depth, title, page index or None) of all items in order."""
        root = self._root() or {}
        top = self.resolve(root.get("Outlines"))
        number = {p.number: k for k, p in reversed(list(enumerate(self.pages())))}
        out, seen = [], set()
        stack = [(top.get("First"), 0)] if isinstance(top, dict) else []
        while stack and len(out) < OUTLINE_ITEMS:
            ref, depth = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen or depth > OUTLINE_DEPTH:
                continue
            seen.add(ref.num)
            item = self.resolve(ref)
            if not isinstance(item, dict):
                continue
            title = self.resolve(item.get("Title"))
            out.append((depth, text_string(title) if isinstance(title, bytes) else "", self._target(item, number)))
            stack += [(item.get("Next"), depth), (item.get("First"), depth + 1)]
        return out

    def _target(self, item: dict, number: dict) -> int | None:
        to = self.resolve(item.get("Dest"))
        if to is None:
            action = self.resolve(item.get("A"))
            to = self.resolve(action.get("D")) if isinstance(action, dict) and action.get("S") == "GoTo" else None
        if isinstance(to, str | bytes):
            to = self._named(to)
        if isinstance(to, dict):
            to = self.resolve(to.get("D"))
        first = to[0] if isinstance(to, list) and to else None
        if isinstance(first, Ref):
            return number.get(first.num)
        return first if isinstance(first, int) and 0 <= first < len(number) else None

    def _named(self, key):
        root = self._root() or {}
        old, tree = self.resolve(root.get("Dests")), self.resolve(root.get("Names"))
        if isinstance(old, dict) and isinstance(key, str) and key in old:
            return self.resolve(old[key])
        raw, node = key.encode("latin-1", "replace") if isinstance(key, str) else key, self.resolve(tree.get("Dests")) if isinstance(tree, dict) else None
        for _ in range(64):
            if not isinstance(node, dict):
                return None
            names = self.resolve(node.get("Names"))
            if isinstance(names, list):
                return next((self.resolve(v) for k, v in zip(names[::2], names[1::2], strict=False) if self.resolve(k) == raw), None)
            free, inside = None, None
            for kid in self.resolve(node.get("Kids")) or []:
                kid = self.resolve(kid)
                limits = self.resolve(kid.get("Limits")) if isinstance(kid, dict) else None
                ends = [self.resolve(x) for x in limits] if isinstance(limits, list) and len(limits) >= 2 else None
                if ends and all(isinstance(x, bytes) for x in ends):
                    inside = inside if inside is not None else kid if ends[0] <= raw <= ends[1] else None
                else:
                    free = free if free is not None else kid
            node = inside if inside is not None else free
        return None


def _meet(a: tuple, b: tuple) -> tuple | None:
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


# Code points of the document encoding where it differs from Latin-1.
_DOC_LOW = "˘ˇˆ˙˝˛˚˜"  # 0x18 to 0x1F
_DOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"  # 0x80 to 0xA0


def text_string(b: bytes) -> str:
    """A text string: UTF-16 or UTF-8 with a mark, else the document encoding."""
    if b[:2] == b"\xfe\xff":
        return b[2 : len(b) - len(b) % 2].decode("utf-16-be", "replace")
    if b[:3] == b"\xef\xbb\xbf":
        return b[3:].decode("utf-8", "replace")
    return "".join(_DOC_LOW[c - 0x18] if 0x18 <= c < 0x20 else _DOC_HIGH[c - 0x80] if 0x80 <= c <= 0xA0 else "�" if c in (0x7F, 0xAD) else chr(c) for c in b)


_XMP = {"title": "title", "creator": "author", "description": "subject", "Keywords": "keywords", "CreatorTool": "creator", "Producer": "producer", "CreateDate": "creation_date", "ModifyDate": "modification_date"}


def parse_xmp(packet: bytes) -> dict[str, str]:
    """Fields of a metadata packet; of lists the first item. What stands before damage counts."""
    out: dict[str, str] = {}
    path: list[str] = []
    text: list[str] = []
    items = [0]

    def start(name, attributes):
        path.append(name.rpartition(":")[2])
        text.clear()
        if path[-1] in _XMP:
            items[0] = 0
        if path[-1] == "Description":
            for k, v in attributes.items():
                if (field := _XMP.get(k.rpartition(":")[2])) and v:
                    out.setdefault(field, v)

    def end(_):
        name, inside = path.pop(), next((p for p in reversed(path) if p in _XMP), None)
        value = "".join(text).strip()
        if name == "li" and inside:
            items[0] += 1
            if items[0] == 1 and value:
                out[_XMP[inside]] = value
        elif name in _XMP and value and not items[0]:
            out[_XMP[name]] = value
        text.clear()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(packet[:10_000_000], True)
    except expat.ExpatError:
        pass
    return out
