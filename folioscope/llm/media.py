"""Media columns: find, validate, correct and carve media by their signatures.

An Aho-Corasick automaton over all magic byte strings passes once over a
payload; a format validator then confirms each candidate's structure and gives
its exact length.  The confirmed object at offset zero corrects the declared
type; confirmed objects elsewhere are carved as embedded media.

Defined results: a null payload is an empty one; an empty or unknown payload
has type ``unknown`` and no embedded objects; of overlapping objects the first
(on a tie the longest) wins; objects that lie whole inside another are embedded
in it.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, bounded_batches

#: Payloads are padded to a positive multiple of so many samples.
FRAME = 576
PAD = 255
WAV_RATE = 8000


def _png(data: bytes, at: int) -> int | None:
    pos, seen_header = at + 8, False
    while pos + 12 <= len(data):
        (length,) = struct.unpack_from(">I", data, pos)
        kind, end = data[pos + 4 : pos + 8], pos + 12 + length
        if end > len(data) or zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if not seen_header and (kind != b"IHDR" or length != 13):
            return None
        seen_header, pos = True, end
        if kind == b"IEND":
            return pos - at
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        (length,) = struct.unpack_from(">H", data, pos + 2)
        if length < 2 or pos + 2 + length > len(data):
            return None
        if marker == 0xDA:
            pos += 2 + length
            while (pos := data.find(b"\xff", pos)) != -1 and pos + 1 < len(data):
                if data[pos + 1] == 0xD9:
                    return pos + 2 - at
                if data[pos + 1] != 0 and not 0xD0 <= data[pos + 1] <= 0xD7:
                    break
                pos += 2
            else:
                return None
            continue
        pos += 2 + length
    return None


def _gif(data: bytes, at: int) -> int | None:
    if len(data) < at + 13:
        return None
    flags, pos = data[at + 10], at + 13
    if flags & 0x80:
        pos += 3 << ((flags & 7) + 1)

    def blocks(pos: int) -> int | None:
        while pos < len(data):
            if data[pos] == 0:
                return pos + 1
            pos += 1 + data[pos]
        return None

    while pos is not None and pos < len(data):
        if data[pos] == 0x3B:
            return pos + 1 - at
        if data[pos] == 0x21:
            pos = blocks(pos + 2)
        elif data[pos] == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos = blocks(pos + 11 + ((3 << ((local & 7) + 1)) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int) -> int | None:
    if len(data) < at + 54:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    if reserved or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124):
        return None
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= offset and offset + rows <= size <= len(data) - at else None


def riff_chunks(data: bytes, at: int = 0) -> tuple[bytes, dict[bytes, tuple[int, int]], int] | None:
    """Form type, chunk spans by name and whole length of a RIFF object, or None if its lengths don't agree."""
    if len(data) < at + 12 or data[at : at + 4] != b"RIFF":
        return None
    (size,) = struct.unpack_from("<I", data, at + 4)
    end = at + 8 + size
    if size < 4 or end > len(data):
        return None
    chunks, pos = {}, at + 12
    while pos + 8 <= end:
        (length,) = struct.unpack_from("<I", data, pos + 4)
        if pos + 8 + length > end:
            return None
        chunks.setdefault(data[pos : pos + 4], (pos + 8, pos + 8 + length))
        pos += 8 + length + (length & 1)
    return (data[at + 8 : at + 12], chunks, end - at) if pos == end else None


def _riff(form: bytes, needed: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def check(data: bytes, at: int) -> int | None:
        found = riff_chunks(data, at)
        return found[2] if found and found[0] == form and any(x in found[1] for x in needed) else None

    return check


def _wav(data: bytes, at: int) -> int | None:
    found = riff_chunks(data, at)
    if not found or found[0] != b"WAVE" or not {b"fmt ", b"data"} <= found[1].keys():
        return None
    start, end = found[1][b"fmt "]
    if end - start < 16:
        return None
    _, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", data, start)
    ok = channels and rate and align == channels * ((bits + 7) // 8) and per_second == rate * align
    return found[2] if ok else None


def _gzip(data: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        pos = at
        while pos < len(data) and not unpack.eof:
            unpack.decompress(data[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(data)) - at - len(unpack.unused_data) if unpack.eof else None


@functools.lru_cache(2)
def _zip_lengths(data: bytes) -> dict[int, int]:
    """Length of the archive that begins at each place, by the end records, each read once."""
    found, end = {}, -1
    while (end := data.find(b"PK\x05\x06", end + 1)) != -1 and end + 22 <= len(data):
        size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
        start = end - offset - size
        if start >= 0 and end + 22 + comment <= len(data):
            found[start] = end + 22 + comment - start
    return found


def _zip(data: bytes, at: int) -> int | None:
    return _zip_lengths(data).get(at)


@functools.lru_cache(2)
def _pdf_lengths(data: bytes) -> dict[int, int]:
    """Length of the file that begins at each header: to the last end mark before the next header, as updates add further ones."""
    found = {}
    starts = [m.start() for m in re.finditer(rb"%PDF-", data)]
    for start, stop in zip(starts, [*starts[1:], len(data)]):
        end = data.rfind(b"%%EOF", start, stop)
        if end != -1 and data.rfind(b"startxref", start, end) != -1:
            found[start] = end + 5 - start
    return found


def _pdf(data: bytes, at: int) -> int | None:
    return _pdf_lengths(data).get(at)


def _flac(data: bytes, at: int) -> int | None:
    """Magic and a whole metadata list; frames have no length, so it runs to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(data):
        kind, length = data[pos] & 0x7F, int.from_bytes(data[pos + 1 : pos + 4], "big")
        if first and (kind or length != 34) or pos + 4 + length > len(data):
            return None
        last, first, pos = data[pos] & 0x80, False, pos + 4 + length
        if last:
            return len(data) - at
    return None


def _ogg(data: bytes, at: int) -> int | None:
    pos = at
    while data[pos : pos + 4] == b"OggS" and pos + 27 <= len(data) and data[pos + 4] == 0:
        segments = data[pos + 26]
        end = pos + 27 + segments + sum(data[pos + 27 : pos + 27 + segments])
        if end > len(data):
            return None
        last, pos = data[pos + 5] & 4, end
        if last:
            return pos - at
    return None


#: Fixed values of the formats: name, magic bytes, validator.
SIGNATURES: tuple[tuple[str, bytes, Callable[[bytes, int], int | None]], ...] = (
    ("png", b"\x89PNG\r\n\x1a\n", _png),
    ("jpeg", b"\xff\xd8\xff", _jpeg),
    ("gif", b"GIF87a", _gif),
    ("gif", b"GIF89a", _gif),
    ("bmp", b"BM", _bmp),
    ("wav", b"RIFF", _wav),
    ("webp", b"RIFF", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    ("avi", b"RIFF", _riff(b"AVI ", (b"LIST",))),
    ("gzip", b"\x1f\x8b\x08", _gzip),
    ("zip", b"PK\x03\x04", _zip),
    ("pdf", b"%PDF-", _pdf),
    ("flac", b"fLaC", _flac),
    ("ogg", b"OggS", _ogg),
)


@functools.cache
def _automaton():
    import ahocorasick

    found: dict[bytes, list] = {}
    for name, magic, check in SIGNATURES:
        found.setdefault(magic, []).append((name, check))
    out = ahocorasick.Automaton()
    for magic, checks in found.items():
        out.add_word(magic.decode("latin-1"), (len(magic), checks))
    out.make_automaton()
    return out


def sniff(data: bytes, inside: bool = False) -> list[tuple[str, int, int]]:
    """Confirmed objects ``(type, start, length)`` of a payload, and with ``inside`` also those that lie whole in one of them."""
    confirmed, free, free_inside = [], 0, 0
    for last, (length, checks) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - length
        if at < (free_inside if inside else free):
            continue
        sized = [(size, name) for name, check in checks if (size := check(data, at))]
        if not sized:
            continue
        size, name = max(sized)
        if at >= free:
            confirmed.append((name, at, size))
            free = at + size
            free_inside = at + length
        elif at + size <= free:
            confirmed.append((name, at, size))
            free_inside = at + size
    return confirmed


FOUND = "detected string, corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint>>"


def _typed(data: bytes, said: str | None) -> tuple[str, bool, list[dict]]:
    found = sniff(data, inside=True)
    kind = found[0][0] if found and found[0][1] == 0 else "unknown"
    rest = [{"type": t, "start": a, "length": n} for t, a, n in found if a]
    return kind, kind != "unknown" and kind != said, rest


def _sniffed(payload: pd.Series, declared: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_typed(data or b"", said) for data, said in zip(payload, declared)], columns=["detected", "corrected", "embedded"])


def sniff_media(df: DataFrame, payload: str, declared: str, into: str = "media_type") -> DataFrame:
    """Add struct column ``into``: the detected type, whether it corrects ``declared``, and the objects after the first one or inside it."""
    return df.withColumn(into, F.pandas_udf(_sniffed, FOUND)(F.col(payload), F.col(declared)))


def to_wav(text: bytes) -> bytes:
    """A text's bytes, padded to whole frames, as samples of an 8-bit mono PCM file."""
    missing = -len(text) % FRAME if text else FRAME
    n = len(text) + missing
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8, b"data", n)
    return b"".join((head, text, bytes([PAD]) * missing))


#: What a document is declared to be before it is stored.
DECLARED = "text"
STORED = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
    "feature string, media_type string, corrected boolean, n_embedded bigint, embedded array<struct<type:string,start:bigint,length:bigint>>"
)


def inspect_wav(data: bytes) -> tuple:
    """Sniff stored media, read the samples back, and compute digests and features of them.

    UTF-8 never holds byte 255, so the unpadded length is found from the samples themselves.
    """
    kind, corrected, embedded = _typed(data, DECLARED)
    if kind != "wav":
        raise ValueError("the stored bytes are no valid wav object")
    start, end = riff_chunks(data)[1][b"data"]
    samples = data[start:end]
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    feature = f"wav;pcm_u8;rate={WAV_RATE};samples={len(samples)};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};distinct={len(share)}"
    return (len(samples.rstrip(b"\xff")), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, corrected, len(embedded), embedded)


def store_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its id and what the stored media of its whole text holds.

    The declared type is that of a text; what is detected corrects it, and
    media inside the samples (a text may hold any) are carved with their places
    in the stored bytes.
    """
    bounded_batches(docs.sparkSession)

    def stored_as(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: to_wav(x or b""))

    def inspected(media: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(inspect_wav, media), columns=[x.split()[0] for x in STORED.split(", ")])

    # of series, not iterators, so both run in one pass of a worker
    store, inspect = F.pandas_udf(stored_as, "binary"), F.pandas_udf(inspected, STORED)
    stored = docs.select("doc_id", inspect(store(blank(text).cast("binary"))).alias("m"))
    return stored.select("doc_id", "m.*")
