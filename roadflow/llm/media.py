"""Media columns: signature sniffing, structure checks, carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a
value.  A validator for each format then walks the structure behind the magic and confirms its length;
a magic without a sound structure is no medium.  The format found at the first byte corrects
the declared type; confirmed media further on are carved out with their place and length.

Documents can be stored as media without loss: UTF-8 bytes, filled up with 255 to a
positive multiple of 576, are the 8-bit samples of a WAV file (mono, unsigned).

Where a format says its end with a mark, the places of all such marks are found once for each value and looked up, and
so are the ends of chained blocks, so that many magics in front of no medium cost no more than a few.

Defined results: a null value has no type, no length and no carved media; an empty one
has type ``application/octet-stream``.  Equal values give equal results; an empty table gives an empty table; a kept column
that is named like an output is returned as ``kept_<name>``.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadflow.llm.common import add_columns

UNKNOWN = "application/octet-stream"
#: Bytes in a block of samples.
BLOCK = 576
RATE = 8000

#: Magic bytes, their place from the start of the medium, media type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "audio/wav"),
    (b"BM", 0, "image/bmp"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"fLaC", 0, "audio/flac"),
]


class Value(bytes):
    """Bytes with the places of marks and the ends of block chains, each found once."""

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on; -1 without one."""
        found = self.__dict__.setdefault("marks", {})
        if mark not in found:
            places = found[mark] = array("q")
            place = self.find(mark)
            while place >= 0:
                places.append(place)
                place = self.find(mark, place + 1)
        i = bisect.bisect_left(found[mark], at)
        return found[mark][i] if i < len(found[mark]) else -1

    def chained(self, at: int) -> int:
        """Behind the blocks (a length byte, so many bytes) that begin at a place, where an empty one ends them; the value's length or more without one."""
        ends = self.__dict__.setdefault("ends", {})
        path = []
        while at < len(self) and at not in ends and self[at]:
            path.append(at)
            at += 1 + self[at]
        end = ends.get(at, at + 1)
        for place in path:
            ends[place] = end
        return end


def _png(v: Value, at: int) -> int:
    pos, seen = at + 8, False
    while pos + 12 <= len(v):
        size, kind = int.from_bytes(v[pos : pos + 4], "big"), v[pos + 4 : pos + 8]
        end = pos + 12 + size
        if not seen and (kind != b"IHDR" or size != 13):
            return 0
        if end > len(v) or zlib.crc32(v[pos + 4 : end - 4]) != int.from_bytes(v[end - 4 : end], "big"):
            return 0
        seen, pos = True, end
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(v: Value, at: int) -> int:
    if at + 13 > len(v):
        return 0
    flags, pos = v[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while pos < len(v):
        kind = v[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(v):
            local = v[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return 0
        pos = v.chained(pos)
    return 0


def _jpeg(v: Value, at: int) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= len(v) and v[pos] == 0xFF:
        mark = v[pos + 1]
        if not 0xC0 <= mark <= 0xFE or mark == 0xD8:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        size = int.from_bytes(v[pos + 2 : pos + 4], "big")
        if size < 2:
            return 0
        pos += 2 + size
        if mark == 0xDA:
            end = v.after(b"\xff\xd9", pos) if frame else -1
            return end + 2 - at if end >= 0 else 0
    return 0


def _wav(v: Value, at: int) -> int:
    if v[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    size = int.from_bytes(v[at + 4 : at + 8], "little") + 8
    if at + size > len(v):
        return 0
    pos = at + 12
    while pos + 8 <= at + size:
        length = int.from_bytes(v[pos + 4 : pos + 8], "little")
        if v[pos : pos + 4] == b"data":
            return size if pos + 8 + length <= at + size else 0
        pos += 8 + length + (length & 1)
    return 0


def _bmp(v: Value, at: int) -> int:
    if at + 30 > len(v):
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", v, at + 2)
    planes, depth = struct.unpack_from("<HH", v, at + 26)
    sound = not spare and header in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if sound and 14 + header <= start <= size <= len(v) - at else 0


def _zip(v: Value, at: int) -> int:
    end = v.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(v):
        return 0
    size, start = struct.unpack_from("<II", v, end + 12)
    note = int.from_bytes(v[end + 20 : end + 22], "little")
    total = end + 22 + note - at
    return total if start + size == end - at and at + total <= len(v) else 0


def _gzip(v: Value, at: int) -> int:
    if v[at + 3] & 0xE0 if at + 3 < len(v) else True:
        return 0
    reader, pos, step = zlib.decompressobj(31), at, 256
    try:
        while pos < len(v) and not reader.eof:  # a little at first; the output is dropped as it comes
            rest = v[pos : pos + step]
            pos, step = pos + len(rest), min(2 * step, 1 << 16)
            while rest and not reader.eof:
                reader.decompress(rest, 1 << 20)
                rest = reader.unconsumed_tail
    except zlib.error:
        return 0
    return pos - at - len(reader.unused_data) if reader.eof else 0


def _pdf(v: Value, at: int) -> int:
    end = v.after(b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= v.after(b"startxref", at) <= end - 9 else 0


def _flac(v: Value, at: int) -> int:
    pos, first = at + 4, True
    while pos + 4 <= len(v):
        kind, size = v[pos] & 0x7F, int.from_bytes(v[pos + 1 : pos + 4], "big")
        if first and (kind or size != 34):
            return 0
        last, first = v[pos] & 0x80, False
        pos += 4 + size
        if last:
            return len(v) - at if pos + 2 <= len(v) and v[pos] == 0xFF and v[pos + 1] & 0xFC == 0xF8 else 0
    return 0


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "image/bmp": _bmp, "application/zip": _zip, "application/gzip": _gzip, "application/pdf": _pdf, "audio/flac": _flac}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, place, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), place, kind))
    found.make_automaton()
    return found


def sniff(value: bytes) -> list[tuple[int, int, str]]:
    """(place, length, type) of every confirmed medium that lies in no earlier one, in order.

    At one place the first confirmed signature counts.  A medium that ends where the value does not
    leaves the rest to be searched.
    """
    out: list[tuple[int, int, str]] = []
    free, known = 0, Value(value)
    for end, (size, place, kind) in automaton().iter(value.decode("latin-1")):
        at = end + 1 - size - place
        if at >= free and (length := VALIDATORS[kind](known, at)):
            out.append((at, length, kind))
            free = at + length
    return out


def corrected(declared: str | None, media: list[tuple[int, int, str]]) -> str:
    """The type found at the first byte; else the declared one, if no signature belongs to it."""
    if media and media[0][0] == 0:
        return media[0][2]
    return declared if declared and declared not in VALIDATORS else UNKNOWN


def store(payload: bytes) -> bytes:
    """Payload as an unsigned 8-bit mono WAV file (a pad byte follows an odd length)."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def samples(value: bytes, at: int = 0) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    pos = at + 12
    while value[pos : pos + 4] != b"data":
        size = int.from_bytes(value[pos + 4 : pos + 8], "little")
        pos += 8 + size + (size & 1)
    size = int.from_bytes(value[pos + 4 : pos + 8], "little")
    return value[pos + 8 : pos + 8 + size]


def payload_of(text: bytes) -> bytes:
    """Text bytes filled up with 255 to a positive multiple of the block."""
    return text + b"\xff" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def feature_of(back: bytes, media: list[tuple[int, int, str]]) -> str:
    """Type, embedded media, and simple signal features of the samples read back."""
    data = np.frombuffer(back, np.uint8)
    total = int(data.sum(dtype=np.int64))
    low, high = int(data.min()), int(data.max())
    crossings = int(np.count_nonzero((data[1:] >= 128) != (data[:-1] >= 128)))
    return f"{media[0][2]};carved={len(media) - 1};samples={len(data)};sum={total};min={low};max={high};crossings={crossings}"


def _store_texts(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    rows = []
    for value in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist():
        value = value or b""
        stored = store(payload_of(value))
        media = sniff(stored)
        back = samples(stored, media[0][0])
        media += [(44 + a, n, k) for a, n, k in sniff(back)]  # what lies inside the samples
        rows.append((len(value), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back, media)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]


def store_documents(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Every text stored as a WAV file and read back; digests of both, and features."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return add_columns(df.select(*dict.fromkeys([*keep, text_col])), _store_texts, fields, keep, text_col)


def _sniff_values(batch: pa.RecordBatch, value: str, declared: str | None) -> list[pa.Array]:
    column = batch.column(batch.schema.get_field_index(value)).to_pylist()
    says = batch.column(batch.schema.get_field_index(declared)).to_pylist() if declared else [None] * len(column)
    kinds, carved = [], []
    for v, d in zip(column, says):
        media = sniff(v) if v else []
        kinds.append(None if v is None else corrected(d, media))
        carved.append(None if v is None else [{"place": a, "length": n, "type": k, "content": v[a : a + n]} for a, n, k in media if a])
    shape = pa.list_(pa.struct([("place", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))
    return [pa.array(kinds, pa.string()), pa.array(carved, shape)]


def sniff_media(df: DataFrame, keep: list[str], value_col: str, declared_col: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``media_type`` (corrected) and ``carved`` (embedded media) of a binary column."""
    fields = "media_type string, carved array<struct<place: long, length: long, type: string, content: binary>>"
    needed = dict.fromkeys([*keep, value_col, *([declared_col] if declared_col else [])])
    return add_columns(df.select(*needed), _sniff_values, fields, keep, value_col, declared_col)
