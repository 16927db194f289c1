"""A small writer of documents: text lines on pages, with any character of the basic plane."""

from __future__ import annotations

import zlib


def text_document(lines: list[str], per_page: int = 50, xref: str = "table", compress: bool = True, info: dict | None = None) -> bytes:
    """A document that shows ``lines`` from top to bottom, ``per_page`` on a page. ``xref``: ``table``, or
    ``stream`` with objects in an object stream."""
    pages = [lines[k : k + per_page] for k in range(0, len(lines), per_page)] or [[]]
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    objects: dict[int, bytes | tuple[str, bytes]] = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /DW 500 >>",
        5: ("", cmap),
    }
    kids = []
    for page in pages:
        num = max(objects) + 1
        kids.append(num)
        body = b"BT /F 10 Tf 12 TL 50 760 Td\n" + b"".join(b"<" + x.encode("utf-16-be", "surrogatepass").hex().encode() + b"> Tj T*\n" for x in page) + b"ET"
        objects[num] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F 3 0 R >> >> /Contents {num + 1} 0 R >>".encode()
        objects[num + 1] = ("/Filter /FlateDecode", zlib.compress(body, 1)) if compress else ("", body)
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    extra = b""
    if info:
        num = max(objects) + 1
        objects[num] = b"<< " + b" ".join(b"/" + k.encode() + b" <FEFF" + v.encode("utf-16-be").hex().encode() + b">" for k, v in info.items()) + b" >>"
        extra = f" /Info {num} 0 R".encode()
    out, places, packed = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}, []
    for num, body in sorted(objects.items()):
        if isinstance(body, bytes) and xref == "stream":
            packed.append((num, body))
            continue
        places[num] = len(out)
        if isinstance(body, tuple):
            body = f"<< {body[0]} /Length {len(body[1])} >>\nstream\n".encode() + body[1] + b"\nendstream"
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    size = max(objects) + 1
    if xref == "table":
        start = len(out)
        rows = "".join(f"{places[k]:010d} 00000 n \n" if k in places else "0000000000 65535 f \n" for k in range(size))
        out += f"xref\n0 {size}\n{rows}trailer\n<< /Size {size} /Root 1 0 R".encode() + extra + b" >>\n"
    else:
        heads, body = [], bytearray()
        for num, b in packed:
            heads.append(f"{num} {len(body)}")
            body += b + b"\n"
        head = (" ".join(heads) + "\n").encode()
        box, table = size, size + 1
        places[box] = len(out)
        data = zlib.compress(head + bytes(body))
        out += f"{box} 0 obj\n<< /Type /ObjStm /N {len(packed)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
        start = places[table] = len(out)
        inner = {num: k for k, (num, _) in enumerate(packed)}
        rows = b"".join((b"\1" + places[k].to_bytes(4, "big") + b"\0\0") if k in places else (b"\2" + box.to_bytes(4, "big") + inner[k].to_bytes(2, "big")) if k in inner else bytes(7) for k in range(table + 1))
        data = zlib.compress(rows)
        out += f"{table} 0 obj\n<< /Type /XRef /Size {table + 1} /W [1 4 2] /Root 1 0 R".encode() + extra + f" /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()
