"""Media columns: what the bytes are, whatever they are declared as, and what is embedded in them.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a
value; a validator of the format then walks its structure and confirms where it
ends. The format confirmed at byte 0 corrects the declared type; those confirmed
further on are carved. Candidates inside a carved span are not tried again.

``as_wave`` is the other direction: bytes as 8-bit mono samples in a WAVE file.

Defined results: a null value has a null type and no spans; an empty or unknown
value has the type ``application/octet-stream``; a damaged file is not reported;
of signatures at the same place the first format of FORMATS that fits counts; a value
of any length is looked through to its end; equal values have equal results, repeated
rows each its own; an empty table gives an empty result; further columns pass, and
those named as the result's are replaced (the digests read only their own).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscope.llm.shared import slices, tidy, written

UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8000
#: A payload is filled up with zero bytes to a multiple of this.
PAYLOAD_UNIT = 64
#: A compressed member is followed for at most this much output at a time.
INFLATE_BYTES = 1 << 20
ZIP = b"PK\3\4"


def png_end(data: bytes, at: int) -> int:
    at += 8
    while at + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + length
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return 0
        at = end
        if kind == b"IEND":
            return at
    return 0


def gif_end(data: bytes, at: int) -> int:
    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    if at + 13 > len(data):
        return 0
    flags = data[at + 10]
    at += 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C and at + 10 < len(data):
            flags = data[at + 9]
            at = blocks(at + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
        else:
            return 0
    return 0


def jpeg_end(data: bytes, at: int) -> int:
    at += 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind < 0xC0 or length < 2:
            return 0
        at += 2 + length
        while kind == 0xDA:  # entropy-coded bytes follow a scan's header
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return 0
            if data[at + 1] == 0xD9:
                return at + 2
            if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                break
            at += 2
    return 0


def riff_end(form: bytes) -> Callable[[bytes, int], int]:
    def end(data: bytes, at: int) -> int:
        if at + 12 > len(data) or data[at + 8 : at + 12] != form:
            return 0
        stop = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        inner = at + 12
        while inner + 8 <= stop <= len(data):
            size = int.from_bytes(data[inner + 4 : inner + 8], "little")
            inner += 8 + size + size % 2
        return stop if inner in (stop, stop + 1) else 0

    return end


def bmp_end(data: bytes, at: int) -> int:
    if at + 30 > len(data):
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    known = header in (12, 40, 52, 56, 64, 108, 124) and not reserved and 14 + header <= start <= size
    return at + size if known and at + size <= len(data) else 0


def gzip_end(data: bytes, at: int) -> int:
    stream = zlib.decompressobj(31)
    left: bytes | memoryview = memoryview(data)[at:]
    try:
        while not stream.eof:
            if not left:
                return 0
            stream.decompress(left, INFLATE_BYTES)
            left = stream.unconsumed_tail
    except zlib.error:
        return 0
    return len(data) - len(stream.unused_data)


def ogg_end(data: bytes, at: int) -> int:
    end = 0
    while data[at : at + 5] == b"OggS\0" and at + 27 <= len(data):
        count = data[at + 26]
        stop = at + 27 + count + sum(data[at + 27 : at + 27 + count])
        if stop > len(data):
            break
        last, at, end = data[at + 5] & 4, stop, stop
        if last:
            break
    return end


def zip_ends(data: bytes) -> dict[int, int]:
    """Where each ZIP archive in the bytes begins and ends: every end-of-directory record says where its archive must begin."""
    found: dict[int, int] = {}
    end = data.find(b"PK\5\6")
    while end >= 0 and end + 22 <= len(data):
        entries, size, start = struct.unpack_from("<HII", data, end + 10)
        directory = end - size
        if start <= directory and (not entries or data[directory : directory + 4] == b"PK\1\2"):
            found.setdefault(directory - start, end + 22 + int.from_bytes(data[end + 20 : end + 22], "little"))
        end = data.find(b"PK\5\6", end + 4)
    return found


def pdf_end(data: bytes, at: int) -> int:
    stop = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, stop if stop >= 0 else len(data))
    return end + 5 if end >= 0 and data.find(b"startxref", at, end) >= 0 else 0


#: Media type, magic bytes (public format descriptions), validator; a ZIP's ends are found once for a value.
FORMATS = [
    ("image/png", b"\x89PNG\r\n\x1a\n", png_end),
    ("image/gif", b"GIF87a", gif_end),
    ("image/gif", b"GIF89a", gif_end),
    ("image/jpeg", b"\xff\xd8\xff", jpeg_end),
    ("audio/wav", b"RIFF", riff_end(b"WAVE")),
    ("image/webp", b"RIFF", riff_end(b"WEBP")),
    ("video/x-msvideo", b"RIFF", riff_end(b"AVI ")),
    ("image/bmp", b"BM", bmp_end),
    ("application/gzip", b"\x1f\x8b\x08", gzip_end),
    ("audio/ogg", b"OggS\0", ogg_end),
    ("application/zip", ZIP, None),
    ("application/pdf", b"%PDF-", pdf_end),
]


def automaton():
    """The magic bytes of all formats; a byte stands as the character of its number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in {m for _, m, _ in FORMATS}:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def confirmed(data: bytes, machine) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed span, outermost first, in order; the content of the outer one is searched too."""
    spans = []
    inside: list[int] = []
    zips: dict[int, int] | None = None
    for last, magic in machine.iter(data.decode("latin-1")):
        at = last - len(magic) + 1
        if inside and at < inside[-1]:
            continue
        if magic == ZIP and zips is None:
            zips = zip_ends(data)
        for kind, m, end in FORMATS:
            if m == magic and (stop := end(data, at) if end else zips.get(at, 0)):
                spans.append((kind, at, stop - at))
                if at:  # what wraps all of the value is looked into
                    inside.append(stop)
                break
    return spans


def as_wave(payload: bytes) -> bytes:
    """The bytes as unsigned 8-bit mono samples in a WAVE file; of even length, so no pad byte is needed."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def wave_samples(media: bytes) -> bytes:
    """The samples of a WAVE file's data chunk."""
    at = 12
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


SPAN = T.StructType().add("type", T.StringType()).add("offset", T.LongType()).add("length", T.LongType())
SNIFFED = T.StructType().add("media_type", T.StringType()).add("media_corrected", T.BooleanType()).add("embedded", T.ArrayType(SPAN))


def sniff(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """df with media_type (as confirmed), media_corrected (differs from the declared type) and embedded spans.

    ``declared`` names a column of declared types, or is None where there are none."""
    df = df.drop(*SNIFFED.names)  # columns with these names are replaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in slices(batch, media):
                kinds, corrected, embedded = [], [], []
                said = part.column(declared).to_pylist() if declared else [None] * part.num_rows
                for data, was in zip(part.column(media), said):
                    if (data := data.as_py()) is None:
                        found, kind = [], None
                    else:
                        found = confirmed(data, machine)
                        kind = found[0][0] if found and not found[0][1] else UNKNOWN
                    kinds.append(kind)
                    corrected.append(kind is not None and kind != was)
                    embedded.append([{"type": k, "offset": a, "length": n} for k, a, n in found if a])
                spans = pa.array(embedded, pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kinds, pa.string()), pa.array(corrected), spans], names=[*part.schema.names, "media_type", "media_corrected", "embedded"])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *SNIFFED.fields]))


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, filled up with zeros, as a WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [x.as_py() or b"" for x in part.column("t").cast(pa.binary())]
                media = [as_wave(x + bytes(-len(x) % PAYLOAD_UNIT or (0 if x else PAYLOAD_UNIT))) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("t")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


DIGEST_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def wave_digests(media: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and a feature string of stored WAVE files.

    The feature has the confirmed type, the embedded spans, and of the samples the
    sum, the sum of squares and the number of times they cross the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for data, kind, spans in zip(part.column("media"), part.column("media_type").to_pylist(), part.column("embedded").to_pylist()):
                    data = data.as_py()
                    payload = wave_samples(data)
                    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
                    above = samples >= 128
                    feature = f"{kind};{','.join(f'{s["type"]}@{s["offset"]}+{s["length"]}' for s in spans)};{samples.sum()};{(samples * samples).sum()};{(above[1:] != above[:-1]).sum()}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=DIGEST_NAMES)

    return media.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_text_media(docs: DataFrame) -> DataFrame:
    """Texts as WAVE files written to the shared folder, read back, sniffed and digested."""
    return wave_digests(sniff(written(text_media(docs), "media", compression="zstd"), "media"))
