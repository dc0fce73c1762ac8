import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoscope import schema as S
from chronoscope.functions import text as X
from chronoscope.functions import times as T
from chronoscope.operators import anomaly, events, resolve, timeline
from chronoscope.sources import sinks


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_a_stable_order_with_equal_times(spark):
    rows = [(5, 24, 0, 1), (5, 1, 0, 9), (5, 1, 1, 0), (4, 30, 0, 0), (5, 1, 0, 2)]
    df = spark.createDataFrame(rows, "primary_ticks long, stage int, file_ord int, rec_ord long").repartition(4)
    assert [tuple(r) for r in timeline.ordered(df).collect()] == sorted(rows)
    assert sorted((r.idx, *tuple(r)[:4]) for r in timeline.numbered(df).collect()) == [(i, *x) for i, x in enumerate(sorted(rows))]


def test_search_and_view(spark):
    df = spark.createDataFrame([(i, f"C:\\Dir{i % 3}\\x") for i in range(10)], "idx long, path string")
    assert timeline.search(df, "dIR1\\").count() == 3 and timeline.search(df, "").count() == 0
    assert tuple(timeline.cursor(timeline.search(df, "dir1"), 5).first()) == (2, 3)
    assert tuple(timeline.cursor(timeline.search(df, "dir1"), 9).first()) == (0, 3)
    assert tuple(timeline.cursor(timeline.search(df, "none"), 0).first()) == (0, 0)
    view = timeline.View(100, 10)
    view.page(1), view.page(1)
    assert (view.selected, view.first) == (20, 11)
    view.bottom(), view.move(5)
    assert (view.selected, view.first) == (99, 90)
    view.half_page(-1), view.top(), view.move(-1)
    assert (view.selected, view.first) == (0, 0)
    timeline.View(0, 5).bottom()
    view.to(50), view.begin_search(), view.to(7), view.cancel_search()
    assert (view.selected, view.first) == (50, 41)
    view.begin_search(), view.to(7)
    assert (view.selected, view.first) == (7, 7)


def test_details(spark):
    at = "timestamp'2024-01-02 03:04:05.678'"
    times = ", ".join(f"'{p}_{n}', {at if (p, n) == ('si', 'accessed') else 'cast(null as timestamp)'}" for p in ("si", "fn") for n in ("created", "modified", "accessed", "entry_modified"))
    rows = spark.sql(f"""select 'p' as path, named_struct({times}) as timestamps, f as anomalies,
      named_struct('mft_entry_number', n, 'mft_sequence', cast(null as int), 'file_size', s, 'is_directory', d) as metadata
      from values (3, 7L, 1536L, true), (0, 8L, cast(null as bigint), cast(null as boolean)), (0, cast(null as bigint), 5L, false) as v(f, n, s, d)""")
    found = [tuple(r) for r in timeline.details(rows).collect()]
    shown = ("C:- M:- A:2024-01-02 03:04:05 E:-", "C:- M:- A:- E:-")
    assert found == [
        ("p", "Entry 7 Seq 0  Size: 1.5 KB [DIR]", *shown, "SI_CREATED < FN_CREATED (timestomping) | SI has zero nanoseconds (tool artifact)"),
        ("p", "Entry 8 Seq 0", *shown, None),
        ("p", None, *shown, None),
    ]


def test_codes(spark):
    assert values(spark, timeline.event_code(F.col("k")), [("RdpSession",), ("LogCleared",)], "k string") == ["RDP", "LogCleared"]
    source = "s struct<kind:string,detail:string>"
    assert values(spark, timeline.source_code(F.col("s")), [(("Evtx", "Security"),), (("Mft", None),)], source) == ["EVT:Security", "MFT"]
    assert S.id_base("PowerShell") == 0x5053 << 48 and max(map(S.id_base, S.ID_PREFIXES)) < 1 << 63


def test_times(spark):
    t = [(0,), (116444735999999999,), (116444736000000000,), (132223104000000017,)]
    assert values(spark, T.filetime_micros("t"), t, "t long") == [None, None, 0, 1577836800000001]
    assert values(spark, T.chrome_micros("t"), [(0,), (-5,), (11644473600000001,), (5,)], "t long") == [None, None, 1, None]
    assert values(spark, T.iso_ticks("t"), [("2020-01-01T00:00:00.1234567Z",), ("x",)], "t string") == [132223104000000000 + 1234567, None]
    month = [(2020, 2, 30), (2020, 2, 29), (0, 1, 1)]
    c = F.lit(1)
    assert [x is None for x in values(spark, T.systemtime(F.col("y"), F.col("m"), F.col("d"), c, c, c), month, "y int, m int, d int")] == [True, False, True]
    assert values(spark, T.shown("t"), [(None,), (datetime(2020, 1, 2, 3, 4, 5, 999999),)], "t timestamp") == ["-", "2020-01-02 03:04:05"]


def test_texts(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1408, "1.4 KB"), (1048576, "1.0 MB"), (5 << 30, "5.0 GB"), (1331, "1.3 KB")]
    assert values(spark, X.humanized("n"), [(n,) for n, _ in sizes], "n long") == [s for _, s in sizes]
    assert values(spark, X.truncated(F.col("p"), 8), [("12345678",), ("123456789",)], "p string") == ["12345678", "...56789"]
    assert values(spark, X.mac_address(F.col("b")), [(bytearray(b"\x00\x1a\xff\x00\x00\x09"),)], "b binary") == ["00:1a:ff:00:00:09"]
    assert values(spark, X.image_path(F.col("p"), "C"), [("/Windows/System32/config/SYSTEM",)], "p string") == ["C:\\Windows\\System32\\config\\SYSTEM"]
    apps = [('[{"application":"a.exe"}]', "a.exe"), ('[{"x":1},{"application":"b"}]', "b"), ("plain", "plain"), ("y" * 101, "y" * 100 + "..."), ("{}", "{}")]
    assert values(spark, X.activity_app(F.col("a")), [(a,) for a, _ in apps], "a string") == [b for _, b in apps]
    assert values(spark, X.username(F.col("p")), [("C:\\users\\Al B\\x",), ("C:\\Windows",)], "p string") == ["Al B", "unknown"]


def test_zero_subseconds_need_ticks(spark):
    rows = [(10_000_000, 10_000_001), (10_000_000, 20_000_000), (5, 6), (None, 1)]
    assert values(spark, anomaly.zero_subseconds((F.col("a"), F.col("b"))), rows, "a long, b long") == [2, 0, 0, 0]
    assert values(spark, anomaly.si_before_fn(F.col("a"), F.col("b")), rows, "a long, b long") == [1, 1, 1, 0]


@pytest.mark.parametrize("reason, code", [(0x100 | 0x80000000, "CREATE"), (0x200 | 0x2000, "DEL"), (0x1000, "REN"), (0x1, "MOD"), (0x800, "SEC"), (0x8000, "ATTR"), (0x801, "MOD"), (0x8800 | 0x80000000, "SEC"), (0x4000, "MOD"), (0x80000000, "MOD")])
def test_reasons(spark, reason, code):
    assert values(spark, events.reason_code(F.col("r")), [(reason,)], "r long") == [code]


def test_descriptions(spark):
    schema = "event_id long, channel string, provider string, computer string, event_data map<string,string>"
    rows = [
        (4104, "c", "p", "h", {"ScriptBlockText": "é" * 150, "Path": "x.ps1"}),
        (4104, "c", "p", "h", {"ScriptBlockText": "short", "Path": ""}),
        (13, "c", "a Sysmon", "h", {"Image": "i", "TargetObject": "o", "Details": "v"}),
        (13, "c", "other", "h", {}),
        (5858, "c", "p", "h", {"PossibleCause": "why"}),
        (1117, "c", "p", "h", {"ThreatName": "t", "Action Name": "gone"}),
        (25, "c", "TerminalServices", "h", {"User": "u"}),
        (4688, "c", "p", "h", {"NewProcessName": "n", "CommandLine": ""}),
    ]
    assert values(spark, events.description(), rows, schema) == [
        "[PowerShell] x.ps1 -> " + "é" * 150 + "...", "[PowerShell] short", "[Sysmon:Registry] i -> o = v", "[EVT:c] EID:13 on h",
        "[WMI:5858]  why", "[Defender:Action] t -> gone", "[RDP] u from - (EID:25)", "[Process] n (?)",
    ]


def test_user_registry_rows(spark):
    text, code = events.user_registry_row()
    rows = [("SearchQuery", "cats", "0", "al"), ("OpenSaveDialog", "f.txt", "txt", "al"), ("LastVisitedApp", "a.exe", "1", "al"), ("TypedPath", "C:\\", "url1", None)]
    df = spark.createDataFrame(rows, "activity string, value_data string, value_name string, username string").select(text, code)
    assert [tuple(r) for r in df.collect()] == [('[SearchQuery] "cats" (user: al)', "Search"), ("[OpenSave] f.txt (user: al, key: txt)", "ACC"), ("[LastVisitedApp] a.exe (user: al)", "EXEC"), ("[TypedPath] C:\\ (user: )", "ACC")]


def test_parent_chain_with_gaps_and_cycles(spark):
    rows = [(1, 1, "root"), (2, 1, "a"), (3, 2, "b"), (4, 99, "lost"), (5, 4, "c"), (6, 7, "x"), (7, 6, "y"), (8, None, "n")]
    rows += [(100 + i, 99 + i if i else 3, f"d{i}") for i in range(40)]
    found = {r.node: r.path for r in resolve.parent_chain(spark.createDataFrame(rows, "node long, parent long, name string")).collect()}
    assert found[3] == "root\\a\\b" and found[5] == "lost\\c" and found[8] == "n"
    assert (found[6], found[7]) == ("x", "y")
    assert found[139] == "\\".join(["root", "a", "b", *(f"d{i}" for i in range(40))])


def _full_row():
    ts = datetime(2025, 8, 10, 3, 41, 20, 123456)
    times = dict.fromkeys(S.TIMESTAMPS.names) | {"si_created": ts}
    return ("MftEntry", 42, 'C:\\a "b"', ts, 1, "FileCreate", "CREATE", times, None, [("Mft", None), ("Evtx", "Sec")], 0x81, {"file_size": 7, "mft_entry_number": 42, "mft_sequence": 3, "is_directory": False, "has_ads": False, "parent_path": None, "sha256": None, "sha1": None}, 1, 0, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([_full_row()], S.TIMELINE)
    row = sinks.csv_rows(df).first()
    assert (row.Timestamp, row.Sources, row.Anomalies, row.SI_Created, row.FN_Created, row.MFT_Entry, row.IsDir) == ("2025-08-10 03:41:20.123", "MFT|EVT:Sec", "STOMP|ADS", "2025-08-10 03:41:20.123", "", "42", "false")
    found = json.loads(sinks.json_rows(df).first().json)
    assert found["entity_id"] == {"MftEntry": 42} and found["sources"] == ["Mft", {"Evtx": "Sec"}] and found["path"] == 'C:\\a "b"'
    assert found["timestamps"]["fn_created"] is None and found["metadata"]["sha256"] is None and found["anomalies"] == 0x81
    second = 1754797280
    assert sinks.bodyfile_rows(df).first().line == f'0|C:\\a "b" (MFT|EVT:Sec)|42-3||0|0|7|-1|-1|-1|{second}'
    sinks.write_csv(df, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert text[0].startswith("Timestamp,Event,Path") and ',"C:\\a ""b""",' in text[1]
    sinks.write_json(df, f"{tmp_path}/json")
    sinks.write_bodyfile(df, f"{tmp_path}/body")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))) == [found]


def test_json_array_kinds_and_times(spark, tmp_path):
    """Kinds outside the list are objects, times have the digits they need, and many rows are one array over all part files."""
    base = list(_full_row())
    rows = []
    for k, (kind, us, ticks) in enumerate([("FileCreate", 0, 0), ("LogCheckpoint", 5000, 0), ("Sysmon:9", 123456, 0), ("BrowseURL", 123456, 7), ("SEC", 0, 1)]):
        ts = datetime(2025, 8, 10, 3, 41, 20 + k, us)
        whole = (int(ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp()) * 1_000_000 + us) * 10 + 116_444_736_000_000_000 + ticks
        rows.append((*base[:3], ts, whole, kind, kind, dict.fromkeys(S.TIMESTAMPS.names) | {"si_created": ts, "prefetch_last_run": [ts]}, dict.fromkeys(S.TICKS.names) | {"si_created": whole}, *base[9:]))
    df = spark.createDataFrame(rows, S.TIMELINE)
    sinks.write_json(df.repartition(4), f"{tmp_path}/json")
    found = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    assert [r["event_type"] for r in found] == ["FileCreate", {"Other": "LogCheckpoint"}, {"Other": "Sysmon:9"}, {"Other": "BrowseURL"}, {"Other": "SEC"}]
    shown = ["2025-08-10T03:41:20Z", "2025-08-10T03:41:21.005Z", "2025-08-10T03:41:22.123456Z", "2025-08-10T03:41:23.123456700Z", "2025-08-10T03:41:24.000000100Z"]
    assert [r["primary_timestamp"] for r in found] == shown == [r["timestamps"]["si_created"] for r in found]
    assert found[1]["timestamps"]["prefetch_last_run"] == [shown[1]] and found[1]["timestamps"]["fn_created"] is None
    sinks.write_json(df.limit(0), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == []
    sinks.write_json(df, f"{tmp_path}/lines", lines=True)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "lines").glob("part-*")) == 5


def test_very_deep_chains_and_large_cycles(spark):
    """A chain of any depth is no cycle, and a cycle ends the rounds as soon as nothing else is open."""
    rows = [(i, i - 1, "d") for i in range(1, 3000)] + [(10_000 + i, 10_000 + (i + 1) % 700, f"c{i}") for i in range(700)] + [(20_000, 10_000, "tail")]
    found = {r.node: (r.path, r.depth) for r in resolve.parent_chain(spark.createDataFrame(rows, "node long, parent long, name string")).collect()}
    assert found[2999][1] == 2999 and found[10_005] == ("c5", 1) and found[20_000] == ("tail", 1)
