import sqlite3
from datetime import datetime

from pyspark.sql import functions as F

from chronoscope import schema as S
from chronoscope.operators import sigma, timeline
from chronoscope.plans import normalize as N
from chronoscope.sources import decoders, sinks

BASE = 132223104000000000  # 2020-01-01 in ticks


def as_of():
    return F.lit("2025-08-10 00:00:00").cast("timestamp")


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def shown(df):
    return [(r.path, r.event_code) for r in df.orderBy("rec_ord", "primary_ticks").collect()]


def test_every_source(spark):
    cases = [
        (N.log_file(table(spark, "offset long, lsn long, clients int, pages long, gap boolean", (4096, 7, 1, 3, True)), as_of()), "$LogFile restart area at offset 0x1000: LSN=7, clients=1, pages=3", "LogCheckpoint"),
        (N.shimcache(table(spark, "path string, ticks long", ("a", BASE), ("none", 0))), "a", "EXEC"),
        (N.bam(table(spark, "sid string, value_name string, ticks long", ("S-1-5", "\\Device\\HarddiskVolume3\\x.exe", BASE), ("S-1-5", "Version", BASE), ("x", "y", BASE))), "C:\\x.exe", "EXEC"),
        (N.services(table(spark, "name string, start int, image_path string, ticks long, control_set int", ("s", 2, "i", BASE, 2), ("t", None, "i", BASE, 1), ("u", 1, "i", BASE, 3))), "[Service:s] Auto -> i", "SVC"),
        (N.autoruns(table(spark, "hive string, name string, command string, key_path string, ticks long", ("SOFTWARE", "n", "c", "k", BASE))), "[Autorun:SOFTWARE] n = c (k)", "REG"),
        (N.user_assist(table(spark, "value_name string, ticks long", ("Nop", BASE))), "Abc", "EXEC"),
        (N.shellbags(table(spark, "folder string, reg_path string, ticks long", (None, "0\\1", BASE))), "[Shellbag] 0\\1", "ACC"),
        (N.recycle_bin(table(spark, decoders.RECYCLED, (1, 5, BASE, "C:\\x"))), "C:\\x", "DEL"),
        (N.recent_lists(table(spark, "key string, name string, ticks long", ("RecentDocs", "d", BASE))), "[MRU:RecentDocs] d", "ACC"),
        (N.user_registry(table(spark, "activity string, value_data string, value_name string, username string, ticks long", ("SearchQuery", "q", "0", "u", None)), as_of()), '[SearchQuery] "q" (user: u)', "Search"),
        (N.powershell(table(spark, "line string, line_no int, username string", ("ls", 3, "u")), as_of()), "[PowerShell:History] ls (user: u, line: 3)", "EXEC"),
        (N.browser_history(table(spark, "browser string, title string, url string, visit_count long, ts timestamp", ("Chrome", "T", "http://x", 2, datetime(2020, 1, 1)))), '[Chrome:History] "T" http://x (visits: 2)', "BrowseURL"),
        (N.activities(table(spark, "app_id string, activity int, start long", ('[{"application":"a"}]', 5, 1577836800))), "[Timeline:Open] a", "EXEC"),
        (N.rdp_bitmaps(table(spark, "file string, username string, tiles long, size long, kind string", ("b.bmc", "u", 2, 9, "RDP8")), as_of()), "[RDP:BitmapCache] b.bmc (user: u, tiles: ~2, size: 9 bytes, ver: RDP8)", "RDP"),
        (N.scheduled_tasks(table(spark, "uri string, action string, author string, date timestamp", ("\\t", "c -x", "al", datetime(2020, 1, 1)))), "[SchedTask] \\t -> c -x (al)", "TASK"),
        (N.jump_lists(table(spark, "target string, written long, accessed long, created long", ("t", 0, BASE, 0))), "t", "ACC"),
        (N.shortcuts(table(spark, decoders.LNK + ", lnk_path string", (BASE, 0, 0, 5, None, "h", "00:01", "l.lnk"))), "l.lnk (via h, MAC: 00:01)", "ACC"),
    ]
    for df, path, code in cases:
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [(f.name, f.dataType.simpleString()) for f in S.TIMELINE]  # up to nullability
        assert shown(df) == [(path, code)]
    assert N.build(*(df for df, *_ in cases)).count() == len(cases)


def test_several_rows_from_one(spark):
    runs = N.prefetch(table(spark, "name string, run_count int, files int, run_ticks array<long>", ("A.EXE", 3, 9, [BASE, 0, BASE + 10])))
    assert shown(runs) == [("A.EXE (run_count: 3, loaded: 9 files)", "EXEC")] * 2 and runs.first().timestamps.prefetch_last_run[1] > runs.first().timestamps.prefetch_last_run[0]
    net = N.network_profiles(table(spark, "profile string, type int, dns string, first timestamp, last timestamp", ("w", 71, "d", datetime(2020, 1, 1), datetime(2020, 1, 2)), ("x", 6, "", None, None), ("", 6, "", datetime(2020, 1, 1), None)))
    assert shown(net) == [("[NetProfile:FirstConnect] w (Wireless, DNS: d)", "NET"), ("[NetProfile:LastConnect] w (Wireless, DNS: d)", "NET")]
    srum = N.resource_usage(table(spark, "table string, app string, user string, ticks long, foreground long, background long, face long, sent long, received long, connected long, rec_ord long", ("App", "a", "u", BASE, 1, 2, 3, None, None, None, 0), ("Net", "a", "u", BASE, None, None, None, 2048, 5, None, 1), ("Conn", "a", "u", BASE, None, None, None, None, None, 9, 2)))
    assert shown(srum) == [("[SRUM:App] a user:u fg:1 bg:2 face:3", "EXEC"), ("[SRUM:Net] a user:u sent:2.0 KB recv:5 B", "NET"), ("[SRUM:Conn] a user:u connected:9s", "NET")]
    wmi = N.wmi(table(spark, "class string, name string, details string, rec_ord long", ("__EventFilter", "f", "first", 0), ("__EventFilter", "f", "again", 1), ("CommandLineEventConsumer", "BVTConsumer", "x", 2)), as_of())
    assert [(r.path, r.event_code, r.anomalies) for r in wmi.orderBy("rec_ord").collect()] == [("[WMI:Filter] f first", "REG", 0x40), ("[WMI:CmdConsumer] BVTConsumer x", "EXEC", 0)]
    am = N.amcache(table(spark, "path string, file_id string, link_date string, key_ticks long, size long", ("p", "0000abcd", "01/02/2020 00:00:00", 5, 7), ("q", "00000000ab", "?", BASE, None)))
    assert sorted((r.path, r.metadata.sha1, r.primary_ts) for r in am.collect()) == [("p", "abcd", datetime(2020, 1, 2)), ("q", "ab", datetime(2020, 1, 1))]


def test_a_timeline_from_files_to_rules(spark):
    times = ", ".join(f"{n} long" for n in S.TICKS.names)
    mft = N.file_table(table(spark, f"entry long, sequence int, path string, {times}, size long, is_directory boolean, has_ads boolean, rec_ord long", (5, 1, "C:\\d", BASE, BASE, BASE, BASE, BASE + 7, BASE + 7, BASE, BASE, 3, True, True, 0), (6, 1, "", *[BASE] * 8, 0, False, False, 1)))
    row = mft.first()
    assert mft.count() == 1 and row.anomalies == 0x83 and row.metadata.is_directory and row.entity_kind == "MftEntry"
    paths = table(spark, "entry long, path string", (5, "C:\\d"))
    usn = N.change_journal(table(spark, decoders.USN + ", rec_ord long", (9, 1, 5, 1, 0, BASE, 0x100, 32, "a.txt", 0), (9, 1, 77, 1, 0, BASE, 0x200, 32, "b.txt", 1)), paths)
    assert shown(usn) == [("C:\\d\\a.txt", "CREATE"), ("b.txt", "DEL")]
    schema = "event_id long, channel string, provider string, computer string, event_data map<string,string>, time string, rec_ord long"
    log = table(spark, schema, (1102, "Security", "p", "h", {}, "2020-01-01T00:00:00.0000001Z", 0), (1, "c", "p", "h", {}, "2020-01-01T00:00:00Z", 1), (4624, "c", "p", "h", {"TargetUserName": "u"}, "bad", 2))
    found = N.event_log(log)
    assert [(r.path, r.event_code, r.anomalies, r.primary_ticks) for r in found.collect()] == [("[LogCleared] Security on h", "LogCleared", 0x20, BASE + 1)]
    whole = timeline.ordered(N.build(found, usn, mft))
    assert [r.stage for r in whole.collect()] == [1, 3, 3, 24]
    assert sinks.csv_rows(whole).count() == 4
    rule = sigma.parse_rule("title: t\ndetection: {s: {TargetUserName: U}, condition: s}")
    assert sigma.detect(log, [rule]).count() == 1


def test_sqlite_histories(spark, tmp_path):
    path = f"{tmp_path}/h.db"
    with sqlite3.connect(path) as db:
        db.executescript("create table urls(id integer primary key, url text, title text, visit_count int); create table visits(id integer primary key, url int, visit_time int); insert into urls values (1, 'http://a', null, 4); insert into visits values (1, 1, 11644473600000001), (2, 1, 11644473600000009), (3, 9, 5)")
    data = open(path, "rb").read()
    files = spark.createDataFrame([(0, bytearray(data)), (1, bytearray(b"junk" * 300))], "file int, content binary")
    rows = decoders.decoded(files, decoders.sqlite_rows(decoders.CHROMIUM_SQL), decoders.HISTORY).orderBy("file", "rec_ord").collect()
    assert [(r.url, r.title, r.visit) for r in rows[:2]] == [("http://a", None, 11644473600000009), ("http://a", None, 11644473600000001)] and rows[2].error
    assert len(decoders.decoded(files.where("file = 0"), decoders.sqlite_rows(decoders.CHROMIUM_SQL, 1), decoders.HISTORY).collect()) == 1
    assert decoders.decoded(files.where("file = 0"), decoders.sqlite_rows(decoders.FIREFOX_SQL), decoders.HISTORY).first().error
