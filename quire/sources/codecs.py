"""Stream filters. Each decoder raises ``CodecError`` with one of the codes below; none returns more than a cap.

Codes: ``corrupted``, ``truncated``, ``invalidCharacter``, ``tooLarge``, ``unsupportedFilter``.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from ..limits import DECODED_BYTES

SPACE = b"\0\t\n\f\r "


class CodecError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def flate(data: bytes, cap: int = DECODED_BYTES) -> bytes:
    """Deflate with or without a zlib header, which leading white space may precede; the checksum is not read."""
    data = data.lstrip(SPACE)
    if len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        if data[1] & 32:
            raise CodecError("corrupted")
        data = data[2:]
    engine = zlib.decompressobj(-15)
    try:
        out = engine.decompress(data, cap + 1)
    except zlib.error as e:
        raise CodecError("corrupted") from e
    if len(out) > cap:
        raise CodecError("tooLarge")
    if not engine.eof:
        raise CodecError("truncated")
    return out


@lru_cache(8)
def _lzw_widths(early: int) -> np.ndarray:
    """The widths of the codes behind a clearing of the table, until it is full."""
    out, size, width = [9], 258, 9
    while True:
        while width < 12 and size + early >= 1 << width:
            width += 1
        out.append(width)
        if size == 4096:
            return np.array(out, np.int64)
        size += 1


def _lzw_codes(padded: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """Codes of these widths from bit ``at`` on."""
    ends = at + np.cumsum(widths)
    first = ends - widths
    byte = first >> 3
    word = padded[byte].astype(np.int64) << 16 | padded[byte + 1].astype(np.int64) << 8 | padded[byte + 2]
    return word >> (24 - (first & 7) - widths) & (1 << widths) - 1


def lzw(data: bytes, early: int = 1, cap: int = DECODED_BYTES) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends, which may be missing.
    A full table stays as it is."""
    fixed = [bytes([i]) for i in range(256)] + [b"", b""]
    widths, bits, at = _lzw_widths(early), 8 * len(data), 0
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out, size, table, last, since = [], 0, list(fixed), None, 0
    while True:
        own = widths[since : since + 4096] if since < len(widths) else np.full(4096, widths[-1])
        own = own[: np.searchsorted(at + np.cumsum(own), bits, "right")]  # whole codes only
        if not len(own):
            break
        codes = _lzw_codes(padded, at, own)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table) < 4096:
                entry = last + last[:1]
            else:
                raise CodecError("corrupted")
            out.append(entry)
            size += len(entry)
            if size > cap:
                raise CodecError("tooLarge")
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
        since += n
        at += int(own[:n].sum())
        if len(stop):
            if codes[n] == 257:
                break
            at += int(own[n])
            table, last, since = list(fixed), None, 0
    return b"".join(out)


def _lzw_packed(codes: list[int], widths: list[int]) -> bytes:
    """The codes, each in so many bits, most significant bit first."""
    values, sizes = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    word, byte = values << (24 - (first & 7) - sizes), first >> 3
    out = np.zeros((int(ends[-1]) + 7) // 8 + 3, np.uint8)
    for k in range(3):  # bits of two codes in one byte don't overlap
        out += np.bincount(byte + k, word >> (16 - 8 * k) & 255, len(out)).astype(np.uint8)
    return out[:-3].tobytes()


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    """The inverse of ``lzw``."""
    codes, widths = [256], [9]
    table, width, following, word = {}, 9, 258, -1  # (code before, byte): code
    find, put, size = table.get, codes.append, widths.append
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        longer = find(key)
        if longer is not None:
            word = longer
            continue
        put(word)
        size(width)
        if following < 4096:
            table[key] = following
            following += 1
            # the decoder is one entry behind
            while width < 12 and following - 1 + early >= 1 << width:
                width += 1
        if following >= 4095:
            put(256)
            size(width)
            table.clear()
            width, following = 9, 258
        word = byte
    if word >= 0:
        put(word)
        size(width)
        if following - 1 + early + 1 >= 1 << width and width < 12:
            width += 1
    put(257)
    size(width)
    return _lzw_packed(codes, widths)


def ascii_hex(data: bytes) -> bytes:
    body = data.split(b">", 1)[0].translate(None, SPACE)
    try:
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("ascii"))
    except ValueError as e:
        raise CodecError("invalidCharacter") from e


def ascii85(data: bytes) -> bytes:
    """Groups of five; ``z`` only at the start of a group, ``~`` ends, ``<~`` may begin. One character left over
    is too few; a group over 32 bits is corrupted."""
    body = data.lstrip(SPACE).removeprefix(b"<~").split(b"~", 1)[0].translate(None, SPACE)
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group)
                group = []
        else:
            raise CodecError("invalidCharacter")
    if len(group) == 1:
        raise CodecError("truncated")
    if group:
        n = len(group) - 1
        out += _base85(group + [84] * (5 - len(group)))[:n]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    if value >> 32:
        raise CodecError("corrupted")
    return value.to_bytes(4, "big")


def run_length(data: bytes, cap: int = DECODED_BYTES) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            return bytes(out)
        step = n + 2 if n < 128 else 2
        if at + step > len(data):
            break
        out += data[at + 1 : at + step] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        if len(out) > cap:
            raise CodecError("tooLarge")
        at += step
    raise CodecError("truncated")


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            end = at + 1
            while end - at < 128 and end < len(data) and data[end] != data[end - 1]:
                end += 1
            n = end - at
            out += bytes([n - 1]) + data[at:end]
        at += n
    return bytes(out) + b"\x80"


def predictor(data: bytes, parameters: dict) -> bytes:
    """Undoes a predictor (``Predictor``, ``Colors``, ``BitsPerComponent``, ``Columns``)."""
    kind = parameters.get("Predictor", 1)
    colors, depth, columns = (parameters.get(k, d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind <= 1:
        return data
    if not (0 < colors <= 32 and depth in (1, 2, 4, 8, 16) and 0 < columns < 1 << 24):
        raise CodecError("corrupted")
    row, step = (colors * depth * columns + 7) // 8, max(1, colors * depth // 8)
    if kind == 2:
        if depth not in (8, 16):
            raise CodecError("unsupportedFilter")
        if len(data) % row:
            raise CodecError("corrupted")
        if depth == 8:
            cells = np.frombuffer(data, np.uint8).reshape(-1, columns, colors)
            return np.cumsum(cells, axis=1, dtype=np.uint8).tobytes()
        cells = np.frombuffer(data, ">u2").reshape(-1, columns, colors)
        return np.cumsum(cells, axis=1, dtype=np.uint16).astype(">u2").tobytes()
    if len(data) % (row + 1):
        raise CodecError("corrupted")
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        above = _png_row(data[at], np.frombuffer(data, np.uint8, row, at + 1), above, step)
        out += above.tobytes()
    return bytes(out)


def _png_row(tag: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if tag == 0:
        return line
    if tag == 2:
        return line + above
    if tag == 1:
        pad = -len(line) % step
        cells = np.r_[line, np.zeros(pad, np.uint8)].reshape(-1, step)
        return np.cumsum(cells, axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    if tag not in (3, 4):
        raise CodecError("corrupted")
    out, up = line.tolist(), above.tolist()
    for i, v in enumerate(out):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if tag == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def png_encode(data: bytes, columns: int) -> bytes:
    """Rows of ``columns`` bytes with the five row filters in turn; the last row is padded with zeros."""
    rows = np.frombuffer(data.ljust(-(-len(data) // columns) * columns, b"\0"), np.uint8).reshape(-1, columns).astype(np.int32)
    above = np.vstack([np.zeros((1, columns), np.int32), rows])[:-1]
    left = np.hstack([np.zeros((len(rows), 1), np.int32), rows[:, :-1]])
    corner = np.hstack([np.zeros((len(rows), 1), np.int32), above[:, :-1]])
    p = left + above - corner
    pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
    tag = np.arange(len(rows)) % 5
    guess = np.choose(tag[:, None], [np.zeros_like(rows), left, above, (left + above) // 2, paeth])
    return np.hstack([tag[:, None], (rows - guess) & 255]).astype(np.uint8).tobytes()


# Fixed values of the format: filter names, long and short.
FILTERS = {
    "FlateDecode": "flate", "Fl": "flate", "LZWDecode": "lzw", "LZW": "lzw", "ASCIIHexDecode": "hex", "AHx": "hex",
    "ASCII85Decode": "a85", "A85": "a85", "RunLengthDecode": "rle", "RL": "rle",
}


def stages(filters, parameters) -> list[tuple[str, dict]]:
    """The chain of (codec, parameters). One parameter dictionary belongs to the first stage."""
    names = filters if isinstance(filters, list) else [] if filters is None else [filters]
    own = parameters if isinstance(parameters, list) else [] if parameters is None else [parameters]
    out = []
    for k, name in enumerate(names):
        if str(name) not in FILTERS:
            raise CodecError("unsupportedFilter")
        p = own[k] if k < len(own) else None
        out.append((FILTERS[str(name)], p if isinstance(p, dict) else {}))
    return out


def decode(data: bytes, chain: list[tuple[str, dict]], cap: int = DECODED_BYTES) -> bytes:
    for codec, p in chain:
        if codec == "flate":
            data = predictor(flate(data, cap), p)
        elif codec == "lzw":
            data = predictor(lzw(data, p.get("EarlyChange", 1), cap), p)
        else:
            data = {"hex": ascii_hex, "a85": ascii85, "rle": run_length}[codec](data)
        if len(data) > cap:
            raise CodecError("tooLarge")
    return data
