import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from chronoscope.llm import media
from tests.llm import odd


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


SAMPLES = {
    "image/png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b""),
    "image/gif": b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c\0\0\0\0\1\0\1\0\0\x02\x02\x44\x01\0\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab12\xff\0" + b"34\xff\xd9",
    "audio/wav": media.as_wave(bytes(64)),
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40),
    "application/gzip": gzip.compress(b"x" * 1000, mtime=0),
    "audio/ogg": b"OggS\0\4" + bytes(20) + b"\1\5hello",
    "application/zip": zipped(),
    "application/pdf": b"%PDF-1.4\nx\nstartxref\n9\n%%EOF",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_each_format(kind):
    data, machine = SAMPLES[kind], media.automaton()
    assert media.confirmed(data, machine)[0] == (kind, 0, len(data))
    assert (kind, 7, len(data)) in media.confirmed(b"before " + data + b" after", machine)
    assert all(k != kind for k, *_ in media.confirmed(data[: len(data) - 2], machine))  # cut short


def test_a_damaged_png_and_plain_text_are_nothing():
    data, machine = bytearray(SAMPLES["image/png"]), media.automaton()
    data[20] ^= 1
    assert media.confirmed(bytes(data), machine) == []
    assert media.confirmed(b"BM PK\3\4 RIFF GIF89a %PDF- " * 200, machine) == []


def zipped_twice() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", zipped())
        z.writestr("b.txt", "more")
    return out.getvalue()


@pytest.mark.parametrize(("kind", "strays"), [("application/zip", [b"PK\3\4 junk", SAMPLES["application/zip"][:-5], b"PK\5\6" + bytes(30)]), ("application/pdf", [b"a %PDF- mention", SAMPLES["application/pdf"][:-3]])])
def test_a_stray_signature_hides_no_later_file(kind, strays):
    data, machine = SAMPLES[kind], media.automaton()
    for stray in strays:
        for before in (stray, stray * 3, b"x" + stray):
            assert (kind, len(before) + 1, len(data)) in media.confirmed(before + b" " + data + b" after", machine)
            twice = media.confirmed(before + b" " + data + stray + b" " + data, machine)
            assert [x for x in twice if x[0] == kind] == [(kind, len(before) + 1, len(data)), (kind, len(before) + len(data) + len(stray) + 2, len(data))]


def test_zips_in_zips():
    data, machine = zipped_twice(), media.automaton()
    inner = data.index(zipped())
    assert media.confirmed(data, machine) == [("application/zip", 0, len(data)), ("application/zip", inner, len(zipped()))]
    assert media.confirmed(b"PK\3\4" + data, machine) == [("application/zip", 4, len(data))]


def test_sniff_corrects_and_carves(spark):
    both = SAMPLES["image/png"] + b"--" + SAMPLES["image/gif"]
    rows = [(1, bytearray(SAMPLES["image/gif"]), "image/png"), (2, bytearray(SAMPLES["image/gif"]), "image/gif"), (3, bytearray(b"xx" + both), None), (4, None, "image/png"), (5, bytearray(b""), "a"), (6, bytearray(both), "image/png")]
    df = spark.createDataFrame(rows, "i int, data binary, said string").selectExpr("*", "1 as embedded")
    found = {r.i: r for r in media.sniff(df, "data", "said").collect()}
    assert [(found[i].media_type, found[i].media_corrected) for i in range(1, 7)] == [("image/gif", True), ("image/gif", False), (media.UNKNOWN, True), (None, False), (media.UNKNOWN, True), ("image/png", False)]
    png = len(SAMPLES["image/png"])
    assert [(s.type, s.offset, s.length) for s in found[3].embedded] == [("image/png", 2, png), ("image/gif", png + 4, len(SAMPLES["image/gif"]))]
    assert [s.offset for s in found[6].embedded] == [png + 2] and found[4].embedded == []


def plain_numbers(payload):
    """Sum, sum of squares and crossings of the middle, sample by sample."""
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    return f"{sum(payload)};{sum(x * x for x in payload)};{crossings}"


def check(rows, texts):
    want, numbers = [], {}
    for i, t in texts:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = media.as_wave(payload)
        numbers[hashlib.sha256(payload).hexdigest()] = plain_numbers(payload)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(want, key=str)
    features = {}
    for r in rows:
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature and r.feature.startswith("audio/wav;")
        assert r.feature.split(";", 2)[2] == numbers[r.payload_sha256]


def test_odd_documents(spark, tmp_path):
    check(media.stored_text_media(odd.table(spark, tmp_path)).collect(), [r[:2] for r in odd.rows()])
    assert media.stored_text_media(odd.empty(spark, tmp_path)).collect() == []


def test_features_name_what_is_embedded(spark):
    """A text with whole files that are text themselves: the stored form's head has 44 bytes, so all offsets are moved by it."""
    pdf = SAMPLES["application/pdf"].decode()
    texts = [(1, "é " + pdf + " and " + pdf), (2, pdf), (3, "%PDF-1.4 without an end"), (4, "x"), (5, None)]
    rows = media.stored_text_media(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    spans = {r.doc_id: r.feature.split(";")[1] for r in rows}
    n = len(pdf)
    assert spans == {1: f"application/pdf@47+{n},application/pdf@{47 + n + 5}+{n}", 2: f"application/pdf@44+{n}", 3: "", 4: "", 5: ""}


def test_very_long_and_repeated_texts(spark):
    docs = spark.range(4).selectExpr("id div 2 as doc_id", "repeat('GIF89a RIFF PK \U0001f600', if(id < 2, 150000, 0)) as text", "1 as media", "2 as embedded", "'t' as t")
    check(media.stored_text_media(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_query(spark, small):
    from chronoscope.llm.registry import op6_media_columns

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    check(op6_media_columns(spark, small).collect(), [tuple(r) for r in docs])
