"""Media columns: types by signature, checked by structure, with embedded media carved out.

An Aho-Corasick automaton finds magic bytes of all known formats in one pass. At each hit the format's
validator walks its structure and gives the length that it declares, or says no. The type at offset 0 corrects a
declared type; hits elsewhere that validate and do not lie within another embedded one are embedded media. What
validators look for far from a hit is found once for all hits, so time grows with the bytes alone. FLAC declares no
length; it is recognised as a whole only and never carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.shared import importable, stored, tidy

#: Rate of the stored sounds, and the unit that payloads are padded to.
RATE, UNIT = 8000, 64
#: What is said of a stored text before its bytes are looked at.
DECLARED = "text/plain"


class Media(bytes):
    """Bytes, with places that are found once: the starts and ends of ZIP archives and PDF documents in them."""

    def zips(self) -> dict[int, int]:
        """{start: end} by each end record: it says how long the entries and their directory before it are."""
        if not hasattr(self, "_zips"):
            self._zips = {}
            for m in re.finditer(b"PK\x05\x06", self):
                end = m.start()
                if end + 22 <= len(self):
                    size, offset, note = *struct.unpack_from("<II", self, end + 12), int.from_bytes(self[end + 20 : end + 22], "little")
                    if end + 22 + note <= len(self) and end - size - offset >= 0:
                        self._zips.setdefault(end - size - offset, end + 22 + note)
        return self._zips

    def pdfs(self) -> dict[int, int]:
        """{start: end} by each trailer, which says how far its cross-reference is from the start; updates make the end later."""
        if not hasattr(self, "_pdfs"):
            self._pdfs = {}
            tables = [m.start() for m in re.finditer(rb"(?<![a-z])xref\b|(?<![0-9])[0-9]{1,10} [0-9]{1,5} obj\b", self)]
            for m in re.finditer(rb"startxref\s{1,4}([0-9]{1,12})\s{1,4}%%EOF", self):
                at, place = bisect_left(tables, m.start()) - 1, int(m[1])
                if at >= 0 and tables[at] >= place:
                    self._pdfs[tables[at] - place] = m.end()
                if 0 < place < m.start() and re.match(rb"xref\b|[0-9]+ [0-9]+ obj\b", self[place : place + 24]):
                    self._pdfs[0] = m.end()  # a document of its own, whatever order it is written in
        return self._pdfs


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(b[at + 8 : at + 12])
    if kind is None or size < 20 or at + size > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= at + size:
        seen.add(b[p : p + 4])
        length = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + length + (length & 1)
    if p < at + size or p > at + size + 1 or (kind == "audio/wav" and not {b"fmt ", b"data"} <= seen):
        return None
    return kind, size


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 8
    while p + 12 <= len(b):
        length = int.from_bytes(b[p : p + 4], "big")
        end = p + 12 + length
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if b[p + 4 : p + 8] == b"IEND":
            return "image/png", end - at
        p = end
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 14 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x2C and p + 10 < len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        elif b[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """Segments by their lengths; after a scan's header its data, in which only stuffed bytes and restarts follow an FF."""
    p, scans = at + 2, 0
    while p + 2 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return ("image/jpeg", p + 2 - at) if scans else None
        if kind == 0xFF:
            p += 1
            continue
        length = int.from_bytes(b[p + 2 : p + 4], "big")
        if kind < 0xC0 or 0xD0 <= kind <= 0xD8 or length < 2:
            return None
        p += 2 + length
        if kind == 0xDA:
            scans += 1
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return None


def _pdf(b: Media, at: int) -> tuple[str, int] | None:
    end = b.pdfs().get(at)
    return ("application/pdf", end - at) if end and end > at else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65_536], 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65_536
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - at - len(d.unused_data)) if d.eof else None


def _zip(b: Media, at: int) -> tuple[str, int] | None:
    end = b.zips().get(at)
    return ("application/zip", end - at) if end else None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", size) if not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start < size <= len(b) - at else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Whole files only: the stream's description, metadata blocks by their lengths, then a frame whose header's checksum holds."""
    if at or b[5:8] != b"\x00\x00\x22" or b[4] & 0x7F:
        return None
    least, rate = int.from_bytes(b[8:10], "big"), int.from_bytes(b[18:21], "big") >> 4
    p, last = 4, False
    while not last and p + 4 <= len(b):
        last = bool(b[p] & 0x80)
        p += 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if not last or least < 16 or not rate or p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return None
    first = b[p + 4]
    size = 5 + (0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1) + {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    crc = 0
    for x in b[p : p + size]:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1 ^ 7) & 0xFF if crc & 0x80 else crc << 1
    return ("audio/flac", len(b)) if p + size < len(b) and crc == b[p + size] else None


_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_checksum(page: bytes) -> int:
    """CRC-32 with the highest bit first, from zlib's, which has it last."""
    mirrored = zlib.crc32(page.translate(_MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        segments = b[p + 26]
        end = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
        page = b[p:end]
        if end > len(b) or _ogg_checksum(page[:22] + bytes(4) + page[26:]) != int.from_bytes(page[22:26], "little"):
            break
        p = end
    return ("audio/ogg", p - at) if p > at else None


#: Each format's leading bytes.
MAGIC: dict[bytes, Callable[[bytes, int], tuple[str, int] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"%PDF-": _pdf,
    b"\x1f\x8b\x08": _gzip,
    b"PK\x03\x04": _zip,
    b"BM": _bmp,
    b"fLaC": _flac,
    b"OggS": _ogg,
}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic in MAGIC:
            _automaton.add_word(magic.decode("latin-1"), magic)
        _automaton.make_automaton()
    return _automaton


def sniff(b: bytes | None, declared: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """(type, [(embedded type, offset, length)]); an unknown type stays as declared, then octet-stream.

    Null and empty media embed nothing. Of hits within one another the first to begin counts.
    """
    kind, embedded, till = declared or "application/octet-stream", [], 0
    b = Media(b or b"")
    for last, magic in automaton().iter(b.decode("latin-1")):
        at = last - len(magic) + 1
        if at and at < till:
            continue
        if found := MAGIC[magic](b, at):
            if at == 0:
                kind = found[0]
            else:
                embedded.append((found[0], at, found[1]))
                till = at + found[1]
    return kind, embedded


def sniff_column(df: DataFrame, media: str, declared: str | None = None, *, id_column: str = "doc_id") -> DataFrame:
    """(id, declared, type, embedded: [(type, offset, length, content)]) for each row.

    Null and empty media keep the declared type and embed nothing; without one they are octet-stream.
    """
    importable(df.sparkSession)
    inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(2).to_pylist() if declared else [None] * batch.num_rows
            content = batch.column(1).to_pylist()
            found = [sniff(b, d) for b, d in zip(content, said, strict=True)]
            carved = [[{"type": t, "offset": at, "length": n, "content": b[at : at + n]} for t, at, n in e] for b, (_, e) in zip(content, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array([k for k, _ in found]), pa.array(carved, inner)], [id_column, "declared", "type", "embedded"])

    columns = [df[id_column].cast("long").alias(id_column), media, *([declared] if declared else [])]
    return df.select(*columns).mapInArrow(tidy(run), f"{id_column} long, declared string, type string, embedded array<struct<type: string, offset: long, length: long, content: binary>>")


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; the payload's bytes are its samples."""
    size = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a sound, found by walking its chunks."""
    p = 12
    while media[p : p + 4] != b"data":
        p += 8 + int.from_bytes(media[p + 4 : p + 8], "little")
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def feature(payload: bytes, kind: str, embedded: list[tuple[str, int, int]]) -> str:
    """Type, samples, mean, spread and sign changes of the samples read, and what is embedded."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    square = int(np.square(x, dtype=np.int64).sum()) / len(x)
    above = x >= 128
    inside = ",".join(f"{t}@{at}+{n}" for t, at, n in embedded)
    return f"{kind};{len(x)};{mean:.4f};{max(0.0, square - mean * mean) ** 0.5:.4f};{int((above[1:] != above[:-1]).sum())};{inside}"


def store(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text as a stored sound, declared as text.

    Null texts are empty; null and repeated ids stay; an empty table gives no rows; other columns are ignored.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [padded(t) for t in part.column(1).to_pylist()]
                said = [DECLARED] * len(made)
                columns = [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(said), pa.array([to_wav(p) for p, _ in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "n_bytes", "declared", "media"])

    return docs.select(docs[id_column].cast("long").alias(id_column), text_column).mapInArrow(tidy(run), f"{id_column} long, n_bytes long, declared string, media binary")


def through_media(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """read_back() of a media column of all texts, written to the shared folder in between."""
    return read_back(stored(store(docs, id_column=id_column, text_column=text_column), "media", like=docs), id_column=id_column)


def read_back(media: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """Digests and features of stored sounds: their type is sniffed, the samples come from the bytes; n_embedded media are within.

    Repeated rows and null ids stay; an empty table gives no rows.
    """
    importable(media.sparkSession)
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "type", "n_embedded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for declared, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kind, embedded = sniff(content, declared)
                p = from_wav(content)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(content), hashlib.sha256(content).hexdigest(), feature(p, kind, embedded), declared, kind, len(embedded)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    kinds = ("long", "long", "long", "string", "long", "long", "string", "string", "string", "string", "long")
    return media.mapInArrow(tidy(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
