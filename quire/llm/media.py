"""MPEG audio in media columns: parsing of any byte string, and lossless storage of payload bytes.

The parser skips an ID3v2 tag, finds frame headers again after damage (a header counts only if another
one or the end follows where its length says), reads Xing, Info and VBRI tables, verifies the frames'
CRC-16 and keeps exact sample counts and the byte offset of every frame. The writer puts 576 payload
bytes into the main data of each Layer III frame, with CRC, a variable-bitrate table and a tag that
records the payload's own length and checksum.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, tidy
from .piece_tokenizer import bounded

UNIT = 576
# Fixed values of the MPEG audio format: kbit/s by bitrate index, and Hz by rate index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The CRC-16 of each row of a byte matrix, from 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) ^ CRC[(crc >> 8) ^ column]) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information of Layer III

    @property
    def data(self) -> int:
        return 4 + 2 * self.protected + self.side


def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    index, rate = b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbit = BITRATES[1 if version == 3 else 2, layer if version == 3 else min(layer, 2)][index]
    hz, pad, mono = RATES[version][rate], b[2] >> 1 & 1, b[3] >> 6 == 3
    if layer == 1:
        length, samples = (12000 * kbit // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbit // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not b[1] & 1, kbit, hz, mono, length, samples, side)


@dataclass
class Parsed:
    first: Header | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek_points: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def duration(self) -> float:
        return self.samples / self.first.rate if self.first else 0.0


_SYNC = re.compile(rb"\xff[\xe2-\xff]")


def _tags(b: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag, and where the tag ends."""
    if b[:3] != b"ID3" or len(b) < 10 or max(b[6:10]) > 127:
        return {}, 0
    end, at, out = 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]), 10, {}
    while at + 10 <= min(end, len(b)) and b[at : at + 4].strip(b"\0"):
        size = struct.unpack(">I", b[at + 4 : at + 8])[0]
        if b[3] >= 4:
            s = b[at + 4 : at + 8]
            size = s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3]
        name, body = str(b[at : at + 4], "latin-1"), b[at + 10 : min(at + 10 + size, end)]
        if name[0] == "T" and body:
            code = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = str(body[1:], code, "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            out[name] = text.rstrip("\0")
        at += 10 + size
    return out, min(end, len(b))


def _table(b: bytes, at: int, h: Header, out: Parsed) -> bool:
    """Reads the variable-bitrate table in the frame at ``at``, if it holds one."""
    for mark, place in ((b"Xing", at + h.data), (b"Info", at + h.data), (b"Xing", at + 4 + h.side), (b"Info", at + 4 + h.side)):
        if b[place : place + 4] == mark:
            frame = b[place + 4 : at + h.length]  # what is cut off stays unknown
            flags, k = int.from_bytes(frame[:4], "big") if len(frame) >= 4 else 0, 4
            out.table = mark.decode()
            for flag, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & flag and len(frame) >= k + 4:
                    setattr(out, name, int.from_bytes(frame[k : k + 4], "big"))
                k += 4 * bool(flags & flag)
            if flags & 4 and len(frame) >= k + 100:
                out.seek_points = [x * (out.table_bytes or 0) // 256 for x in frame[k : k + 100]]
            return True
    place = at + 36
    if b[place : place + 4] == b"VBRI" and at + h.length >= place + 26:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, scale, width = struct.unpack(">IIHHH", b[place + 10 : place + 24])
        raw = b[place + 26 : place + 26 + n * width]
        steps = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), max(1, width))]
        out.seek_points = np.cumsum([0, *steps]).tolist()
        return True
    return False


def parse(b: bytes) -> Parsed:
    """Everything the stream tells; never fails. ``offsets`` are those of audio frames, without the table's."""
    out = Parsed()
    out.tags, at = _tags(b)
    end = len(b) - 128 if b[-128:-125] == b"TAG" and len(b) - 128 >= at else len(b)
    if end < len(b):
        out.tags.setdefault("TIT2", str(b[end + 3 : end + 33], "latin-1").rstrip("\0 "))
    buf = np.frombuffer(b, np.uint8)
    offsets, lengths, heads, sure = [], [], [], False
    while at + 4 <= end:
        h = header(b[at : at + 4])
        if h and at + h.length <= end and (sure or at + h.length == end or header(b[at + h.length : at + h.length + 4])):
            if out.first is None:
                out.first = h
                if _table(b, at, h, out):
                    at, sure = at + h.length, True
                    continue
            # frames with this very header follow one another: taken at once
            n = (end - at) // h.length
            grid = buf[at : at + n * h.length].reshape(n, h.length)[:, :4]
            same = (grid == grid[0]).all(axis=1)
            n = int(np.argmin(same)) if not same.all() else n
            offsets.append(at + h.length * np.arange(n))
            lengths.append(np.full(n, h.length))
            heads.append((h, at, n))
            at, sure = at + n * h.length, True
            continue
        found = _SYNC.search(b, at + 1, end)
        new = found.start() if found else end
        out.skipped += new - at
        out.resyncs += sure
        at, sure = new, False
    if at < end:
        out.skipped += end - at
    if offsets:
        out.offsets, out.lengths = np.concatenate(offsets), np.concatenate(lengths)
    for h, at, n in heads:
        out.samples += n * h.samples
        if h.protected and h.layer == 3:
            rows = buf[at : at + n * h.length].reshape(n, h.length)
            covered = np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + h.side]], axis=1)
            stored = rows[:, 4].astype(np.uint32) << 8 | rows[:, 5]
            out.crc_checked += n
            out.crc_bad += int((crc16(covered) != stored).sum())
    return out


# MPEG-1 Layer III, CRC, 224 kbit/s, 48 kHz, stereo: 672 bytes a frame.
_HEAD = bytes([0xFF, 0xFA, 0xC4, 0x00])
_H = header(_HEAD)


def _side(bits: int) -> bytes:
    """Side information in which each of the four granule channels claims a quarter of ``bits``."""
    value, width = 0, 20
    for _ in range(4):
        value, width = value << 59 | (bits // 4) << 47, width + 59
    return value.to_bytes(width // 8, "big")


def _frame_start(bits: int) -> bytes:
    side = _side(bits)
    crc = int(crc16(np.frombuffer(_HEAD[2:] + side, np.uint8)[None])[0])
    return _HEAD + struct.pack(">H", crc) + side


_AUDIO, _EMPTY = _frame_start(8 * UNIT), _frame_start(0)


def _text_frame(name: str, value: str) -> bytes:
    body = b"\0" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + struct.pack(">IH", len(body), 0) + body


def write(data: bytes) -> bytes:
    """``data`` as an MPEG audio stream; padded with bytes 255 to a positive multiple of ``UNIT``."""
    n = max(1, -(-len(data) // UNIT))
    payload = data.ljust(n * UNIT, b"\xff")
    frames = np.zeros((n + 1, _H.length), np.uint8)
    frames[0, : _H.data] = np.frombuffer(_EMPTY, np.uint8)
    toc = bytes(min(255, k * 256 // 100) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, frames.size) + toc
    frames[0, _H.data : _H.data + len(table)] = np.frombuffer(table, np.uint8)
    frames[1:, : _H.data] = np.frombuffer(_AUDIO, np.uint8)
    frames[1:, _H.data : _H.data + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    tags = _text_frame("payload_bytes", str(len(data))) + _text_frame("payload_crc32", str(zlib.crc32(payload)))
    size = len(tags)
    return b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tags + frames.tobytes()


def payload(b: bytes, info: Parsed) -> bytes:
    """The payload bytes of a stream made by ``write``, damaged or missing frames left out."""
    if info.first is None or not len(info.offsets):
        return b""
    at = info.offsets[info.offsets + _H.data + UNIT <= len(b)] + _H.data
    return np.frombuffer(b, np.uint8)[at[:, None] + np.arange(UNIT)].tobytes()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``media`` binary): the UTF-8 bytes of each text as an MPEG audio stream.

    Null and empty texts give one frame of padding. Rows are independent; repeated rows and null ids
    pass through, equal texts give equal streams. Only the two columns are read.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for lo, hi in bounded(batch.column(1)):
                media = [write(x) for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(media, pa.binary())], ["_id", "_media"])

    return docs.select(F.col(id_col).alias("_id"), raw_text(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, _media binary").toDF(id_col, "media")


INFO = (
    "version int, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration_s double, bitrate int, "
    "vbr_table string, vbr_frames long, vbr_bytes long, crc_checked long, crc_bad long, resyncs long, skipped_bytes long, "
    "tags map<string,string>, frame_offsets array<long>"
)


def describe(b: bytes) -> tuple[dict, Parsed]:
    p = parse(b)
    h = p.first
    size = int(p.lengths.sum())
    return {
        "version": {3: 10, 2: 20, 0: 25}[h.version] if h else None,
        "layer": h.layer if h else None,
        "sample_rate": h.rate if h else None,
        "channels": (1 if h.mono else 2) if h else None,
        "n_frames": len(p.offsets),
        "n_samples": p.samples,
        "duration_s": p.duration,
        "bitrate": round(size * 8 * h.rate / p.samples) if p.samples else None,
        "vbr_table": p.table or None,
        "vbr_frames": p.table_frames,
        "vbr_bytes": p.table_bytes,
        "crc_checked": p.crc_checked,
        "crc_bad": p.crc_bad,
        "resyncs": p.resyncs,
        "skipped_bytes": p.skipped,
        "tags": p.tags,
        "frame_offsets": p.offsets,
    }, p


def parse_media(frame: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(``id_col``, ``info`` struct): what the MPEG audio stream of each row holds, with exact durations
    and the offset of every frame. Null or foreign bytes give no frames; nothing fails."""
    kind = dict(frame.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for lo, hi in bounded(batch.column(1)):
                infos = [describe(x or b"")[0] for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for x in infos:
                    x["tags"] = list(x["tags"].items())
                    x["frame_offsets"] = x["frame_offsets"].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(infos, _INFO)], ["_id", "_info"])

    return frame.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m")).mapInArrow(tidy(run), f"_id {kind}, _info struct<{_struct(INFO)}>").toDF(id_col, "info")


def _struct(columns: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in re.split(r",\s+", columns)))


_INFO = pa.struct(
    [
        (n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<long>": pa.list_(pa.int64())}[t])
        for n, t in (c.strip().split(" ", 1) for c in re.split(r",\s+", INFO))
    ]
)


def media_digests(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads stored streams back: sizes and digests of payload and stream, and a feature string of the
    stream's format, exact duration, seek offsets and the payload's byte statistics. Null, foreign and
    damaged streams give nulls."""
    kind = dict(stored.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for lo, hi in bounded(batch.column(1)):
                rows = []
                for b in batch.column(1).slice(lo, hi - lo).to_pylist():
                    d, p = describe(b or b"")
                    back = payload(b or b"", p)
                    if not back or p.tags.get("payload_crc32") != str(zlib.crc32(back)) or not re.fullmatch("[0-9]{1,18}", p.tags.get("payload_bytes", "")) or p.crc_bad:
                        rows.append((None,) * 7)
                        continue
                    bytes_ = np.frombuffer(back, np.uint8)
                    feature = (
                        f"mpeg{d['version'] / 10:g} layer{d['layer']} {d['sample_rate']}Hz {d['channels']}ch {d['bitrate']}bit/s frames={d['n_frames']} "
                        f"samples={d['n_samples']} table={d['vbr_table']}:{d['vbr_frames']} crc={d['crc_checked']} "
                        f"seek={p.offsets[0]}..{p.offsets[-1]} mean={bytes_.sum(dtype=np.int64)}/{len(back)} distinct={len(np.unique(bytes_))}"
                    )
                    rows.append((int(p.tags["payload_bytes"]), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(b), sha256(b).hexdigest(), feature))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], list("iabcdefg"))

    out = stored.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m")).mapInArrow(tidy(run), f"i {kind}, a long, b long, c string, d long, e long, f string, g string")
    return out.toDF(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
