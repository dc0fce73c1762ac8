import sqlite3
import struct
import zipfile

from chronoscope import cli
from chronoscope.plans.collection_timeline import Collection
from tests.test_sources import usn

HIDDEN = "uploads/auto/C%3A/"


def archive(folder) -> str:
    db = f"{folder}/h.db"
    with sqlite3.connect(db) as c:
        c.executescript("create table urls(id integer primary key, url text, title text, visit_count int); create table visits(id integer primary key, url int, visit_time int); insert into urls values (1, 'http://a', 'A', 4); insert into visits values (1, 1, 13222310400000000)")
    restart = bytearray(4096)
    restart[:4], restart[24:26], restart[48:58] = b"RSTR", (48).to_bytes(2, "little"), (77).to_bytes(8, "little") + (2).to_bytes(2, "little")
    task = '<?xml version="1.0" encoding="UTF-16"?><Task><RegistrationInfo><Date>2024-05-06T07:08:09</Date><Author>al</Author><URI>\\t</URI></RegistrationInfo><Actions><Exec><Command>c.exe</Command></Exec></Actions></Task>'
    files = {
        "uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J": usn("a.txt", 0x100) + usn("b.txt", 0x200),
        "uploads/ntfs/%5C%5C.%5CC%3A/$LogFile": bytes(restart) * 2 + b"RCRD" + bytes(4092),
        HIDDEN + "Users/al/x.lnk": b"junk",
        HIDDEN + "$Recycle.Bin/S-1/$Iabc.txt": struct.pack("<QQQI", 2, 6, 132223104000000000, 4) + "C:\\y".encode("utf-16-le"),
        HIDDEN + "Users/al/ConsoleHost_history.txt": b"ls\r\n\r\nwhoami\r\n",
        HIDDEN + "Users/al/Chrome/History": open(db, "rb").read(),
        HIDDEN + "Windows/System32/Tasks/t": b"\xff\xfe" + task.encode("utf-16-le"),
        HIDDEN + "Users/al/Cache/c.bmc": b"RDP8" + bytes(100),
        "elsewhere/x": b"",
    }
    path = f"{folder}/Collection-h-2025.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return path


def test_end_to_end(spark, tmp_path):
    found = Collection(spark, archive(tmp_path), "2025-01-01 00:00:00")
    assert {r.artifact_class: r.n for r in found.counts().collect()} == dict.fromkeys(["usnjrnl_j", "logfile", "lnk", "recycle_bin", "powershell", "browser", "scheduled_task", "rdp_cache"], 1)
    rows = found.timeline().orderBy("stage", "file_ord", "rec_ord").collect()
    assert [(r.event_code, r.path) for r in rows] == [
        ("LogCheckpoint", "$LogFile restart area at offset 0x0: LSN=77, clients=2, pages=1"),
        ("LogCheckpoint", "$LogFile restart area at offset 0x1000: LSN=77, clients=2, pages=1"),
        ("CREATE", "a.txt"),
        ("DEL", "b.txt"),
        ("DEL", "C:\\y"),
        ("EXEC", "[PowerShell:History] ls (user: al, line: 1)"),
        ("EXEC", "[PowerShell:History] whoami (user: al, line: 3)"),
        ("BrowseURL", '[Chrome:History] "A" http://a (visits: 4)'),
        ("RDP", "[RDP:BitmapCache] c.bmc (user: al, tiles: ~1, size: 104 bytes, ver: RDP8)"),
        ("TASK", "[SchedTask] \\t -> c.exe (al)"),
    ]
    assert [(r.artifact_class, r.error) for r in found.errors().collect()] == [("lnk", "ValueError: not a shortcut")]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([archive(tmp_path), "--export-csv", f"{tmp_path}/out", "--as-of", "2025-01-01"]) == 0
    assert "powershell: 1" in capsys.readouterr().err
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "out").glob("part-*.csv")) == 10


def test_a_folder_gives_what_its_archive_gives(spark, tmp_path):
    packed, folder = archive(tmp_path), f"{tmp_path}/Collection-h-2025"
    with zipfile.ZipFile(packed) as z:
        z.extractall(folder)
    (tmp_path / "outside.lnk").write_bytes(b"not the collection's")
    (tmp_path / "Collection-h-2025" / HIDDEN / "link.lnk").symlink_to(tmp_path / "outside.lnk")
    one, other = (Collection(spark, x, "2025-01-01 00:00:00") for x in (packed, folder))
    assert sorted(map(tuple, one.counts().collect())) == sorted(map(tuple, other.counts().collect()))
    a, b = (sorted((r.event_code, r.path, str(r.primary_ts)) for r in x.timeline().collect()) for x in (one, other))
    assert a == b and len(a) == 10
    assert [(r.artifact_class, r.error) for r in other.errors().collect()] == [("lnk", "ValueError: not a shortcut")]
    assert cli.archive_host(folder + "/") == "h"


def test_no_size_hides_a_file(spark, tmp_path):
    """A journal over 1 GiB (sparse, as they are) gives all its rows; what is too large to be read as a whole is an error row."""
    path = f"{tmp_path}/Collection-h-2025.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open(zipfile.ZipInfo("uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J"), "w", force_zip64=True) as file:
            file.write(usn("a.txt", 0x100))
            for _ in range(257):
                file.write(bytes(4 << 20))
            file.write(usn("b.txt", 0x200))
        z.writestr(HIDDEN + "Users/al/x.lnk", bytes((2 << 20) + 1))
    found = Collection(spark, path, "2025-01-01 00:00:00")
    assert [(r.event_code, r.path) for r in found.timeline().orderBy("rec_ord").collect()] == [("CREATE", "a.txt"), ("DEL", "b.txt")]
    assert [(r.artifact_class, r.error) for r in found.errors().collect()] == [("lnk", "ValueError: no content")]


def test_streams_cross_chunks_and_batches(spark, tmp_path, monkeypatch):
    import io

    from chronoscope.sources import collection, decoders

    data = b"".join(usn(f"{i}.txt", 0x100) + bytes(8 * (i % 5)) + (b"\x01" * 8 if i % 7 == 0 else b"") for i in range(9000))
    whole = list(decoders.usn_records(data))
    assert [r[-1] for r in whole] == [f"{i}.txt" for i in range(9000)]
    monkeypatch.setattr(decoders, "RECORD_BYTES", 200)
    for chunk in (200, 331, 4096):
        monkeypatch.setattr(decoders, "CHUNK", chunk)
        assert list(decoders.usn_stream(io.BytesIO(data), len(data))) == whole
    arrow_rows = [b.num_rows for b in decoders.batches_of(iter([(i,) for i in range(9000)]), {}, ["x"], __import__("pyarrow").schema([("rec_ord", "int64"), ("x", "int64"), ("error", "string")]))]
    assert arrow_rows == [8192, 808]
    (tmp_path / "big.bin").write_bytes(b"abc")
    assert [(r.size, r.content) for r in collection.folder_bytes(spark, str(tmp_path), most=2).collect()] == [(3, None)]


JOURNAL, LOG = "uploads/ntfs/%5C%5C.%5CC%3A/$Extend/$UsnJrnl%3A$J", "uploads/ntfs/%5C%5C.%5CC%3A/$LogFile"


def folder_of(root, files: dict[str, bytes]) -> str:
    for name, data in files.items():
        place = root / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    return str(root)


def history(folder, name: str) -> bytes:
    with sqlite3.connect(f"{folder}/{name}") as c:
        c.executescript("create table urls(id integer primary key, url text, title text, visit_count int); create table visits(id integer primary key, url int, visit_time int); insert into urls values (1, 'http://a', 'A', 4); insert into visits values (1, 1, 13222310400000000), (2, 1, 13222310500000000)")
    return open(f"{folder}/{name}", "rb").read()


def test_one_bad_file_among_good_ones(spark, tmp_path):
    """Of every class: good rows stay, bad files are named, whatever their bytes are."""
    task = "<Task><RegistrationInfo><Date>2024-05-06T07:08:09</Date></RegistrationInfo><Actions><{0}>{1}</{0}></Actions></Task>"
    link = bytes.fromhex("4c0000000114020000000000c000000000000046") + struct.pack("<IIQQQI", 0, 0, *[132223104000000000] * 3, 77) + bytes(20)
    tasks, users = HIDDEN + "Windows/System32/Tasks/", HIDDEN + "Users/al/"
    files = {
        users + "ok.lnk": link,
        users + "bad.lnk": link[:50],
        HIDDEN + "$Recycle.Bin/S-1/$Iok": struct.pack("<QQQI", 2, 6, 132223104000000000, 4) + "C:\\y".encode("utf-16-le"),
        HIDDEN + "$Recycle.Bin/S-1/$Ibad": b"\xff" * 40,
        users + "a/ConsoleHost_history.txt": b"l\xe9s\xff\n\xc3\xa9t\xe2\x82",
        users + "b/ConsoleHost_history.txt": b"\xff\xfe" + "wide\r\n".encode("utf-16-le") + b"\x00\xd8",
        users + "c/ConsoleHost_history.txt": b"\xfe\xff" + "big".encode("utf-16-be"),
        tasks + "ok": task.format("Exec", "<Command>c.exe</Command>").encode(),
        tasks + "be": b"\xfe\xff" + task.format("ComHandler", "<ClassId> {1} </ClassId>").encode("utf-16-be"),
        tasks + "latin": task.format("Exec", "<Command>caf\xe9</Command>").encode("latin-1"),
        tasks + "early": b"<Task><RegistrationInfo><Date>2024-05-06T07:08:09</Date></RegistrationInfo><Actions><Exec><Command>e</Command>",
        tasks + "broken": b"<Task><broken",
        tasks + "junk": b"\xff\xfe\xff",
        tasks + "none": task.format("Other", "").encode(),
        users + "Chrome/History": history(tmp_path, "ok.db"),
        users + "Edge/History": b"SQLite format 3\0" + b"\xff" * 500,
        users + "x/ActivitiesCache.db": b"no database",
        users + "Cache/ok.bmc": b"RDP8" + bytes(100),
        users + "Cache/short.bmc": b"RDP8",
        JOURNAL: usn("a.txt", 0x100) + b"\xff" * 80 + usn("b.txt", 0x100)[:-4] + b"\xfe\xff",
        LOG: b"\xff" * 5000,
        users + "ok.customdestinations-ms": b"junk" + link + b"junk",
        HIDDEN + "Windows/System32/wbem/Repository/OBJECTS.DATA": b"\xff__EventFilter\xff",
    }
    for place in (folder_of(tmp_path / "Collection-h-2025", files), f"{tmp_path}/Collection-z-2025.zip"):
        if place.endswith(".zip"):
            with zipfile.ZipFile(place, "w") as z:
                for name, data in files.items():
                    z.writestr(name, data)
        found = Collection(spark, place, "2025-01-01 00:00:00")
        rows = {(r.event_code, r.path) for r in found.timeline().collect()}
        assert rows >= {
            ("ACC", "C:\\Users\\al\\ok.lnk"),
            ("DEL", "C:\\y"),
            ("EXEC", "[PowerShell:History] l\ufffds\ufffd (user: al, line: 1)"),
            ("EXEC", "[PowerShell:History] \u00e9t\ufffd (user: al, line: 2)"),
            ("EXEC", "[PowerShell:History] wide (user: al, line: 1)"),
            ("EXEC", "[PowerShell:History] big (user: al, line: 1)"),
            ("TASK", "[SchedTask]  -> c.exe ()"),
            ("TASK", "[SchedTask]  -> COM:{1} ()"),
            ("TASK", "[SchedTask]  -> caf\ufffd ()"),
            ("TASK", "[SchedTask]  -> e ()"),
            ("BrowseURL", '[Chrome:History] "A" http://a (visits: 4)'),
            ("RDP", "[RDP:BitmapCache] ok.bmc (user: al, tiles: ~1, size: 104 bytes, ver: RDP8)"),
            ("CREATE", "a.txt"),
        }
        assert sum(code == "TASK" for code, _ in rows) == 4 and sum(code == "RDP" for code, _ in rows) == 1
        named = sorted((r.artifact_class, r.windows_path.rpartition("\\")[2]) for r in found.errors().collect())
        assert named == [("activities", "ActivitiesCache.db"), ("browser", "History"), ("lnk", "bad.lnk"), ("recycle_bin", "$Ibad"), ("scheduled_task", "broken"), ("scheduled_task", "junk")]
        assert found.remove()


def test_a_file_is_decoded_once(spark, tmp_path, monkeypatch):
    """The timeline and the errors come from one reading of each file."""
    from chronoscope.plans import collection_timeline
    from chronoscope.sources import decoders

    marks = tmp_path / "marks"
    marks.mkdir()
    folder = str(marks)

    def counted(data):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield from decoders.link(data)

    monkeypatch.setitem(collection_timeline.WHOLE, "lnk", (counted, decoders.LNK))
    found = Collection(spark, archive(tmp_path), "2025-01-01 00:00:00")
    assert found.timeline().count() == 10 and found.errors().count() == 1 and found.timeline().count() == 10
    assert len(list(marks.iterdir())) == 1


def test_damaged_entries_have_an_error_and_no_rows(spark, tmp_path):
    path = f"{tmp_path}/Collection-h-2025.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(JOURNAL, usn("a.txt", 0x100))
        z.writestr(HIDDEN + "Users/al/ConsoleHost_history.txt", b"whoami and more of it\n" * 5)
        z.writestr(HIDDEN + "Users/bo/ConsoleHost_history.txt", b"ls\n")
    data = bytearray(open(path, "rb").read())
    with zipfile.ZipFile(path) as z:
        crc = z.getinfo(HIDDEN + "Users/al/ConsoleHost_history.txt").CRC.to_bytes(4, "little")
    open(path, "wb").write(bytes(data).replace(crc, bytes(4)))
    found = Collection(spark, path, "2025-01-01 00:00:00")
    assert {r.path for r in found.timeline().collect()} == {"a.txt", "[PowerShell:History] ls (user: bo, line: 1)"}
    assert [r.windows_path for r in found.errors().collect()] == ["C:\\Users\\al\\ConsoleHost_history.txt"]


def test_many_collections_at_once(spark, tmp_path):
    """Each collection's own journal and log count; rows know their host; the union is that of the single ones."""
    (tmp_path / "a").mkdir()
    one = archive(tmp_path / "a")
    other = folder_of(tmp_path / "Collection-h2-2024-02-03T04", {JOURNAL: usn("c.txt", 0x100), HIDDEN + "Users/al/ConsoleHost_history.txt": b"id\n"})
    both = Collection(spark, [one, other], "2025-01-01 00:00:00")
    shown = lambda c: sorted((r.event_code, r.path) for r in c.timeline().collect())
    assert shown(both) == sorted(shown(Collection(spark, one, "2025-01-01 00:00:00")) + shown(Collection(spark, other, "2025-01-01 00:00:00")))
    with_host = both.timeline().join(both.hosts(), "file_ord").select("path", "host", "collected").collect()
    assert {(r.path, r.host, r.collected) for r in with_host} >= {("c.txt", "h2", "2024-02-03T04"), ("a.txt", "h", "2025")}
    assert len(with_host) == 12


def test_collections_do_not_mix(spark, tmp_path):
    """The same persistent name on two hosts is two rows; a journal's parents are those of its own collection."""
    import pytest

    wmi = HIDDEN + "Windows/System32/wbem/Repository/OBJECTS.DATA"
    places = [folder_of(tmp_path / f"Collection-h{i}-2025", {JOURNAL: usn("c.txt", 0x100), wmi: b'x__EventFilter Name="same"'}) for i in (1, 2)]
    both = Collection(spark, places, "2025-01-01 00:00:00")
    paths = spark.createDataFrame([(7, "C:\\one", places[0]), (7, "C:\\two", places[1])], "entry long, path string, archive string")
    parts = both.parts(paths)
    assert sorted(r.path for r in parts["UsnJrnl"].collect()) == ["C:\\one\\c.txt", "C:\\two\\c.txt"]
    assert parts["Wmi"].count() == 2
    with pytest.raises(ValueError, match="archive"):
        both.parts(paths.drop("archive"))


def test_ranges_give_the_rows_of_the_whole(spark, tmp_path):
    """Journals cut at any place: records over borders, zero stretches over ranges, bytes that look like records, and records that break the walk."""
    import io
    import random

    from chronoscope.sources import decoders, ranges

    rng = random.Random(6)
    for case in range(6):
        parts = []
        for i in range(400):
            parts.append(usn(f"{'n' * rng.randint(1, 90)}{i}", rng.choice([0x100, 0x200, 0x80000000])))
            if case >= 1 and rng.random() < 0.05:
                parts.append(bytes(8 * rng.randint(1, 900)))
            if case >= 2 and rng.random() < 0.05:
                parts.append(rng.randbytes(8 * rng.randint(1, 20)))
            if case >= 3 and rng.random() < 0.03:  # a length that reaches over what follows
                parts.append(struct.pack("<IHH", rng.choice([400, 4000, 30001]), 2, 1) + bytes(72))
            if case >= 4 and rng.random() < 0.03:  # a record within another's name
                inner = usn("inner", 0x100)
                parts.append(usn(inner.decode("utf-16-le", "surrogatepass") if len(inner) % 2 == 0 else "x", 0x100) if False else struct.pack("<IHH", 60 + 12 + len(inner), 2, 0) + bytes(64) + inner)
        data = b"".join(parts)
        whole = [row for row in decoders.JournalWalk(io.BytesIO(data), len(data))]
        folder = folder_of(tmp_path / f"Collection-r{case}-2025", {JOURNAL: data})
        for size in (512, 4096, 40_000):
            found = Collection(spark, folder, range_bytes=size)
            rows = found.rows("usnjrnl_j").orderBy("rec_ord").collect()
            assert [(r.place, r.entry, r.usn, r.reason, r.name) for r in rows] == [(r[0], r[1], r[5], r[7], r[9]) for r in whole], (case, size)
            found.remove()
    assert ranges.beginning(io.BytesIO(bytes(1000)), 1000, 8, 1000) == (None, None)


def test_log_ranges(spark, tmp_path):
    from chronoscope.sources import decoders

    restart = bytearray(4096)
    restart[:4], restart[24:26], restart[48:58] = b"RSTR", (48).to_bytes(2, "little"), (77).to_bytes(8, "little") + (2).to_bytes(2, "little")
    record, zero = b"RCRD" + bytes(4092), bytes(4096)
    for pages, gap in (([record] * 9 + [zero], False), ([record, zero, zero, zero, record], True), ([zero] * 5 + [record] * 4, False), ([record] * 7 + [b"xxxx" + bytes(4092)], True)):
        folder = folder_of(tmp_path / f"Collection-{gap}{len(pages)}-2025", {LOG: bytes(restart) * 2 + b"".join(pages)})
        found = Collection(spark, folder, range_bytes=8192)
        log = found.rows("logfile")
        assert [r.page_no for r in log.orderBy("rec_ord").collect()] == list(range(len(pages) + 2))
        for segment in (1, 2, 3, 100):
            assert [tuple(r)[1:] for r in decoders.log_summary(log, "file_ord", segment).collect()] == [(sum(p is record for p in pages), 77, gap)]
        found.remove()


def test_data_source(spark, tmp_path, monkeypatch):
    """Two archives in one load, with host and time; a filter on the class opens only its entries."""
    from pyspark.sql import functions as F

    from chronoscope.sources import collection, datasource

    (tmp_path / "a").mkdir()
    one = archive(tmp_path / "a")
    other = folder_of(tmp_path / "Collection-h2-2024-02-03T04", {JOURNAL: usn("c.txt", 0x100), HIDDEN + "Users/al/x.lnk": b"y", HIDDEN + "Users/al/NTUSER.DAT": b"regf"})
    datasource.register(spark)
    files = spark.read.format("collection").load(f"{tmp_path}/a/Collection-*.zip, {other}")
    rows = files.collect()
    assert sorted({(r.host, r.collected) for r in rows}) == [("h", "2025"), ("h2", "2024-02-03T04")]
    assert len(rows) == 11 and all(len(r.content) == r.size and r.error is None for r in rows)
    expected = collection.manifest(spark.createDataFrame([(r.ordinal, r.original_path) for r in rows], "ordinal long, original_path string")).collect()
    assert sorted((r.original_path, r.windows_path, r.accessor, r.artifact_class, r.hive_type, r.username) for r in rows) == sorted((r.original_path, r.windows_path, r.accessor, r.artifact_class, r.hive_type, r.username) for r in expected)
    links = files.where("artifact_class = 'lnk' and size > 0")
    assert sorted(r.content for r in links.select("content").collect()) == [b"junk", b"y"]
    reader = datasource.CollectionReader({"path": f"{one},{other}"})
    left = list(reader.pushFilters([datasource.EqualTo(("artifact_class",), "lnk"), datasource.In(("host",), ("h2", "x")), datasource.EqualTo(("size",), 1)]))
    assert [f.attribute for f in left] == [("size",)]
    assert [row[4] for part in reader.partitions() for row in part.rows] == [HIDDEN + "Users/al/x.lnk"]
    assert spark.read.format("collection").option("content", "false").load(one).where(F.col("content").isNotNull()).count() == 0
    assert [r.error for r in spark.read.format("collection").option("maxBytes", "2").load(one).where("artifact_class = 'powershell'").collect()] == ["ValueError: larger than 2 bytes"]
    assert spark.read.format("collection").load(one).where("artifact_class = 'srum'").count() == 0


def test_planning_agrees_with_columns(spark):
    from chronoscope.sources import collection

    paths = ["uploads/auto/C%3A/Users/Al/NTUSER.DAT", "uploads/ntfs/%5C%5C.%5CC%3A/$MFT", "uploads/ntfs/%5C%5C.%5CD%3A/$MFT", "uploads/auto/", "x", "uploads/auto/%ff", "uploads/auto/a+b%2B.lnk", "uploads/auto/C%3A/Windows/System32/config/SYSTEM", "uploads/auto/C%3A/$Recycle.Bin/$Ia.evtx", "uploads/auto/C%3A/Windows/System32/sru/SRUDB.dat", "uploads/auto/D%3A/Firefox/places.sqlite", "uploads/auto/\u00e9"]
    rows = collection.manifest(spark.createDataFrame(list(enumerate(paths)), "ordinal long, original_path string")).collect()
    want = [(i, path, *collection.class_of(path), collection.user_of(path)) for i, p in enumerate(paths) if (path := collection.path_of(p)) is not None]
    assert [(r.ordinal, r.windows_path, r.artifact_class, r.hive_type, r.username) for r in sorted(rows, key=lambda r: r.ordinal)] == want
    assert [collection.collection_name(p) for p in ("/e/Collection-a-b-2025-08-10T03_41_20Z.zip", "/e/Collection-c.zip", "/e/other.zip")] == [("a-b", "2025-08-10T03_41_20Z"), ("c", ""), ("other", "")]
