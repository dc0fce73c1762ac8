import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from chronoscope.sources import collection, decoders

PATHS = [
    ("uploads/ntfs/%5C%5C.%5CC%3A/$MFT", "C:\\$MFT", "mft", None),
    ("uploads/auto/C%3A/Windows/System32/config/SYSTEM", "C:\\Windows\\System32\\config\\SYSTEM", "registry", "System"),
    ("uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J", "C:\\$Extend\\$UsnJrnl:$J", "usnjrnl_j", None),
    ("uploads/auto/C%3A/a b/Start Menu/Word.lnk", "C:\\a b\\Start Menu\\Word.lnk", "lnk", None),
    ("uploads/ntfs/%5C%5C.%5CD%3A/x.lnk", None, None, None),
    ("some/random/path.txt", None, None, None),
    ("uploads/auto/%FF/x", None, None, None),
    ("uploads/auto/C%3A/$Recycle.Bin/S-1/$Iab+c.lnk", "C:\\$Recycle.Bin\\S-1\\$Iab+c.lnk", "lnk", None),
    ("uploads/auto/C%3A/$Recycle.Bin/S-1/$Iabc.txt", "C:\\$Recycle.Bin\\S-1\\$Iabc.txt", "recycle_bin", None),
    ("uploads/auto/C%3A/Users/al/AppData/Edge/History", "C:\\Users\\al\\AppData\\Edge\\History", "browser", None),
    ("uploads/auto/C%3A/Users/al/NTUSER.DAT", "C:\\Users\\al\\NTUSER.DAT", "registry", "NtUser"),
    ("uploads/auto/C%3A/Windows.old/System32/config/SAM", "C:\\Windows.old\\System32\\config\\SAM", "registry", "Sam"),
    ("uploads/auto/C%3A/Windows/Prefetch/A.EXE-1.pf", "C:\\Windows\\Prefetch\\A.EXE-1.pf", "prefetch", None),
    ("uploads/auto/C%3A/Windows/appcompat/Amcache.hve", "C:\\Windows\\appcompat\\Amcache.hve", "amcache", "Amcache"),
    ("uploads/auto/C%3A/readme.md", "C:\\readme.md", None, None),
]


def test_paths_and_classes(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PATHS)], "i int, p string")
    rows = df.select("i", collection.windows_path(F.col("p")).alias("w")).select("i", "w", collection.artifact_class(F.col("w")).alias("c"), collection.hive_type(F.col("w")).alias("h")).orderBy("i").collect()
    assert [(r.w, r.c if r.w else None, r.h if r.w else None) for r in rows] == [p[1:] for p in PATHS]


def test_manifest_and_zip(spark, tmp_path):
    archive = f"{tmp_path}/Collection-h-2025.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for i, (p, *_) in enumerate(PATHS):
            z.writestr(p, f"content {i}")
    files = collection.manifest(collection.listing(spark, archive))
    assert files.count() == sum(p[1] is not None for p in PATHS)
    found = {r.ordinal: r.content for r in collection.entry_bytes(files, archive).collect()}
    assert all(bytes(c) == f"content {i}".encode() for i, c in found.items())
    assert {r.artifact_class for r in collection.singles(files).collect()} == {"mft", "usnjrnl_j"}


def test_folder(spark, tmp_path):
    top = tmp_path / "uploads" / "auto"
    top.mkdir(parents=True)
    (top / "x.lnk").write_bytes(b"abc")
    assert [tuple(r) for r in collection.folder_bytes(spark, str(tmp_path)).collect()] == [("uploads/auto/x.lnk", 3, bytearray(b"abc"))]


def usn(name: str, reason: int, major: int = 2, entry: int = 5 | 2 << 48) -> bytes:
    raw = name.encode("utf-16-le")
    wide = 16 if major == 3 else 0
    refs = b"".join(x.to_bytes(8 + wide // 2, "little") for x in (entry, 7 | 1 << 48))
    size = 60 + wide + len(raw)
    body = struct.pack("<IHH", -(-size // 8) * 8, major, 0) + refs + struct.pack("<qQIIIIHH", 99, 132223104000000000, reason, 0, 0, 32, len(raw), 60 + wide) + raw
    return body + bytes(-len(body) % 8)


def files(spark, *contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "file int, content binary")


def test_usn(spark):
    good = usn("a.txt", 0x100) + bytes(512) + usn("closed", 0x80000000) + usn("ü中", 0x80000100, 3) + usn("b", 1)
    rows = decoders.decoded(files(spark, good, b"", good[:70], None), decoders.usn_records, decoders.USN).orderBy("file", "rec_ord").collect()
    first = [r for r in rows if r.file == 0]
    assert [(r.name, r.entry, r.sequence, r.parent, r.reason) for r in first] == [("a.txt", 5, 2, 7, 0x100), ("ü中", 5, 2, 7, 0x80000100), ("b", 5, 2, 7, 1)]
    assert [r.error for r in rows if r.file == 3] == ["ValueError: no content"] and not [r for r in rows if r.file == 1]


def test_log_file(spark):
    restart = bytearray(4096)
    restart[:4], restart[24:26], restart[48:56] = b"RSTR", (48).to_bytes(2, "little"), (1234).to_bytes(8, "little")
    record, zero, odd = b"RCRD" + bytes(4092), bytes(4096), b"x" * 4096
    contents = [restart + restart + record + record, restart + restart + record + zero + record, restart + restart + zero + record, restart + restart + record + odd, restart]
    pages = decoders.decoded(files(spark, *map(bytes, contents)), decoders.log_pages, decoders.LOG_PAGES)
    rows = decoders.log_summary(pages).orderBy("file").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 1234, False), (1, 2, 1234, True), (2, 1, 1234, False), (3, 1, 1234, True), (4, 0, 1234, False)]


def test_links_and_recycled(spark):
    path = b"C:\\t.txt\0"
    info = struct.pack("<IIIII", 28 + len(path), 28, 1, 0, 28) + bytes(8) + path
    tracker = struct.pack("<II", 96, 0xA0000003) + bytes(8) + b"host\0".ljust(16, b"\0") + bytes(58) + bytes([0, 1, 2, 3, 4, 255])
    relative = "..\\t.txt"
    name = struct.pack("<H", len(relative)) + relative.encode("utf-16-le")
    head = lambda flags: decoders.LINK_HEAD + struct.pack("<IIQQQI", flags, 0, 11, 12, 13, 77) + bytes(20)
    assert len(head(0)) == 76
    rows = decoders.decoded(files(spark, head(2) + info + tracker, head(8 | 128) + name, b"junk", head(0)[:50]), decoders.link, decoders.LNK).orderBy("file").collect()
    assert (rows[0].created, rows[0].accessed, rows[0].written, rows[0].size, rows[0].target, rows[0].machine, rows[0].mac) == (11, 12, 13, 77, "C:\\t.txt", "host", "00:01:02:03:04:ff")
    assert rows[1].target == relative and rows[2].error and rows[3].error
    one = struct.pack("<QQQ", 1, 5, 9) + "C:\\x".encode("utf-16-le").ljust(520, b"\0")
    two = struct.pack("<QQQI", 2, 6, 9, 4) + "C:\\y".encode("utf-16-le")
    rows = decoders.decoded(files(spark, one, two, struct.pack("<QQQQ", 3, 0, 0, 0), b"short"), decoders.recycled, decoders.RECYCLED).orderBy("file").collect()
    assert [(r.version, r.size, r.path) for r in rows[:2]] == [(1, 5, "C:\\x"), (2, 6, "C:\\y")] and rows[2].error and rows[3].error


def test_column_only_artifacts(spark):
    lines = spark.createDataFrame([(1, " a \r\n\r\n\tb\n"), (2, ""), (3, None)], "f int, text string")
    assert [tuple(r) for r in decoders.text_lines(lines, "text", "f").collect()] == [(1, 1, "a"), (1, 3, "b")]
    caches = files(spark, b"RDP8" + bytes(40000), b"RDP6" + bytes(20), b"XXXX" + bytes(12), b"RDP8")
    assert [(r.kind, r.tiles) for r in decoders.rdp_cache(caches).orderBy("file").collect()] == [("RDP8", 2), ("RDP6", 1), ("Unknown", 1)]
    xml = '<?xml version="1.0"?><Task xmlns="http://x"><RegistrationInfo><Date>2024-05-06T07:08:09.1</Date><Author>al</Author><URI>\\t</URI></RegistrationInfo><Actions>{}</Actions></Task>'
    tasks = spark.createDataFrame([(0, xml.format("<Exec><Command>c.exe</Command><Arguments>-x</Arguments></Exec>")), (1, xml.format("<ComHandler><ClassId>{1}</ClassId></ComHandler>"))], "i int, xml string")
    rows = decoders.scheduled_task(tasks).orderBy("i").collect()
    assert [(r.author, r.uri, r.action) for r in rows] == [("al", "\\t", "c.exe -x"), ("al", "\\t", "COM:{1}")] and rows[0].date.year == 2024


def test_stream_detection(spark, tmp_path):
    from chronoscope.operators import sigma
    from chronoscope.streaming.detect import detect_stream, sessions

    schema = "event_id long, channel string, computer string, provider string, event_data map<string,string>, ts timestamp"
    spark.sql("select 4624L as event_id, 'c' as channel, 'h' as computer, 'p' as provider, map('a', 'b') as event_data, timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/in")
    rule = sigma.parse_rule("title: t\ndetection: {s: {EventID: 4624}, condition: s}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = detect_stream(stream, [rule]).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.rule_title for r in spark.table("hits").collect()] == ["t"]
    assert sessions(stream, "ts", "5 minutes", "computer", late="1 hour").isStreaming


@pytest.mark.parametrize("data", [b"", b"\0" * 100, b"\xff" * 5000])
def test_decoders_survive_anything(data):
    for decode in (decoders.usn_records, decoders.log_pages, decoders.link, decoders.recycled):
        try:
            list(decode(data))
        except (ValueError, struct.error, IndexError):
            pass
