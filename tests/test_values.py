"""Registry values as columns, event records as XML, shortcuts within custom jump lists."""

import struct
from datetime import datetime

from pyspark.sql import functions as F

from chronoscope.functions import values as V
from chronoscope.plans import normalize as N
from chronoscope.sources import decoders

BASE = 132223104000000000  # 2020-01-01 in ticks


def of(spark, use, *values):
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, v binary")
    return [r.x for r in df.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_and_times(spark):
    assert of(spark, lambda v: V.number(v, 1, 4), b"\0\x01\x02\x03\xff", b"\0\1\2\3", b"", None) == [0xFF030201, None, None, None]
    assert of(spark, V.filetime_value, struct.pack("<Qxx", BASE), b"\xff" * 8, b"1234567") == [BASE, None, None]
    good = struct.pack("<8H", 2020, 2, 6, 29, 23, 59, 58, 999)
    assert of(spark, V.systemtime_value, good, struct.pack("<8H", 2021, 2, 6, 29, 0, 0, 0, 0), bytes(16), good[:15], None) == [datetime(2020, 2, 29, 23, 59, 58), None, None, None, None]


def test_user_assist_forms(spark):
    long_form = struct.pack("<4I44xQ4x", 0, 7, 8, 9, BASE)
    found = of(spark, V.user_assist_value, long_form, struct.pack("<IIQ", 0, 3, BASE + 1), b"short")
    assert [tuple(x) if x else None for x in found] == [(7, 8, 9, BASE), (3, None, None, BASE + 1), None]


def test_recent_order(spark):
    end = 0xFFFFFFFF
    assert of(spark, V.recent_order, struct.pack("<4I", 5, 0, end, 9), struct.pack("<2I", 1, 2) + b"xy", struct.pack("<I", end), b"", b"abc", None)[:5] == [[5, 0], [1, 2], [], [], []]


def record(system="", data="", head='<Event xmlns="http://x">'):
    return f'{head}<System><Provider Name="P" Guid="g"/><EventID Qualifiers="3"> 4624 </EventID>{system}<TimeCreated SystemTime="2020-01-01T00:00:00.1234567Z"/><Channel>Security</Channel><Computer>h &amp; i</Computer></System>{data}</Event>'


def test_event_records(spark):
    fields = '<EventData><Data Name="A">1</Data><Data>no name</Data><Data Name="B"></Data><Data Name="A">&lt;2</Data><Data Name="C"> c </Data></EventData>'
    plain = record(data=fields).replace(' Qualifiers="3"', "")
    prefixed = '<e:Event xmlns:e="http://x"><e:System><e:EventID>1</e:EventID><e:TimeCreated SystemTime="t"/></e:System></e:Event>'
    texts = [record(data=fields), plain, record(data='<UserData><Data Name="U">u</Data></UserData>'), "<Event><System>", "", None, "<Event><System><EventID>x</EventID></System></Event>", prefixed]
    rows = decoders.event_records(spark.createDataFrame(list(enumerate(texts)), "i int, xml string")).orderBy("i").collect()
    first = (4624, "Security", "P", "h & i", {"A": "<2", "C": "c"}, "2020-01-01T00:00:00.1234567Z")
    assert [tuple(r)[1:] for r in rows[:2]] == [first, first]
    assert rows[2].event_data == {"U": "u"} and [(r.i, r.event_id) for r in rows[3:]] == [(7, 1)]
    row = N.event_log(decoders.event_records(spark.createDataFrame([(texts[0],)], "xml string"))).first()
    assert row.event_code == "LOGON" and row.primary_ticks == BASE + 1234567


def test_custom_jump_lists(spark):
    def shortcut(target):
        base = target.encode() + b"\0"
        info = struct.pack("<IIIII", 28 + len(base), 28, 1, 0, 28) + bytes(8) + base
        return decoders.LINK_HEAD + struct.pack("<IIQQQI", 2, 0, BASE, BASE + 1, BASE + 2, 9) + bytes(20) + info

    data = b"junk" + shortcut("C:\\a") + b"between" + decoders.LINK_HEAD + b"\xff" * 70 + shortcut("C:\\b") + decoders.LINK_HEAD
    files = spark.createDataFrame([("x", bytearray(data)), ("y", bytearray(b"")), ("z", None)], "windows_path string, content binary")
    rows = decoders.decoded(files, decoders.custom_links, decoders.CUSTOM_LINKS).orderBy("windows_path", "rec_ord").collect()
    assert [(r.target, r.written) for r in rows if r.windows_path == "x" and r.target in ("C:\\a", "C:\\b")] == [("C:\\a", BASE + 2), ("C:\\b", BASE + 2)]
    assert rows[0].offset == 4 and [r.windows_path for r in rows if r.error] == ["z"]


def test_wmi_repository(spark, monkeypatch):
    import io

    data = bytes(300) + b'CommandLineEventConsumer\0\0Name="Bad One"\0CommandLineTemplate="cmd.exe /c x"\xff' + bytes(900)
    data += b'__EventFilter.Name="F".\0SELECT * FROM __Tick WHERE a' + b'"' + bytes(900)
    data += b'___EventFilter' + bytes(900) + b'__FilterToConsumerBinding\0Consumer="A"\0Filter="B" BVTConsumer' + bytes(900)
    data += b'ActiveScriptEventConsumer ScriptText = y"' + bytes(900) + b"CommandLineEventConsumer"
    whole = list(decoders.wmi_stream(io.BytesIO(data), len(data)))
    for chunk in (1, 7, 256, 1000):  # the same rows, however the file is cut
        monkeypatch.setattr(decoders, "CHUNK", chunk)
        assert list(decoders.wmi_stream(io.BytesIO(data), len(data))) == whole
    assert [(data[at : at + 8], len(context)) for at, _, context in whole][0] == (b"CommandL", 768) and len(whole) == 5
    found = decoders.wmi_entries(spark.createDataFrame([(*row, i) for i, row in enumerate(whole)], decoders.WMI + ", rec_ord long"))
    assert [(r["class"], r.name, r.details) for r in found.orderBy("offset").collect()] == [
        ("CommandLineEventConsumer", "Bad One", "CommandLineTemplate: cmd.exe /c x"),
        ("__EventFilter", "F", "SELECT * FROM __Tick WHERE a"),
        ("__FilterToConsumerBinding", "Unknown", "ConsumerBinding -> FilterToConsumerBinding"),
        ("ActiveScriptEventConsumer", "Unknown", "ScriptText: y"),
        ("CommandLineEventConsumer", "Unknown", ""),
    ]
    rows = N.wmi(found, F.lit("2025-08-10").cast("timestamp")).collect()
    assert {r.path.split("] ")[0]: r.anomalies for r in rows if "Unknown" not in r.path or "Binding" in r.path} == {"[WMI:CmdConsumer": 0x40, "[WMI:Filter": 0x40, "[WMI:Binding": 0}


def test_names_of_an_id_map(spark):
    """Identifiers, texts with lone surrogates, odd lengths and controls; the last blob that says a name counts."""
    from chronoscope.functions import values
    from chronoscope.operators import resolve

    user = bytes.fromhex("0105000000000005" "15000000" "01000000" "ffffffff" "03000000" "f4010000")
    texts = {b"": "", "C:\\é\U0001f600\0\0".encode("utf-16-le"): "C:\\é\U0001f600", b"a\0\x00\xd8b\0": "a\ufffdb", b"\x00\xdc\x00\xd8": "\ufffd\ufffd", b"a\0b": "a", b"a": ""}
    rows = spark.createDataFrame([(bytearray(x),) for x in [*texts, user]], "x binary").select("x", values.wide_text(F.col("x")).alias("t"), values.sid(F.col("x")).alias("s")).collect()
    assert {bytes(r.x): r.t for r in rows if bytes(r.x) != user} == texts
    assert [r.s for r in rows] == [None] * len(texts) + ["S-1-5-21-1-4294967295-3-500"]
    assert spark.range(1).select(values.wide_text(F.lit(None).cast("binary")).alias("t"), values.id_name(F.lit(None).cast("binary")).alias("n")).first() == (None, None)
    blobs = [(1, 1, user), (1, 2, "last".encode("utf-16-le")), (2, 1, "first".encode("utf-16-le")), (2, 2, b"\x01\0\x02\0"), (3, 1, user[:-1]), (None, 1, user), (4, 1, None)]
    found = resolve.id_map(spark.createDataFrame([(i, n, None if b is None else bytearray(b)) for i, n, b in blobs], "id int, n int, b binary"), "id", "b", "n")
    assert sorted(map(tuple, found.collect())) == [(1, "last"), (2, "first")]


def test_dates_of_several_formats(spark, small):
    """A parser sees only texts of its form and gives what it gave without that test; the inventory's dates are parsed once a row, not once for each use."""
    from chronoscope import catalog
    from chronoscope.functions import times as T

    texts = ["2024-02-29T01:02:03Z", "2024-02-29T01:02:03+05", "2024-02-29t01:02:03z", "2024-02-29T01:02:03-0530", "+12024-02-29 01:02:03", "-0001-02-28 01:02:03", "02/29/2024 01:02:03", "2024-02-29 01:02:03", "02/30/2024 01:02:03", "2024-13-01 00:00:00", " 2024-02-29 01:02:03", "2024-02-29 01:02:03\n", "2024-2-9 01:02:03", "soon", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = [F.try_to_timestamp("x", F.lit(f)) for f in T.INVENTORY_FORMATS]
    found = rows.select("x", F.coalesce(*plain).cast("string").alias("want"), T.one_of_formats("x", *T.INVENTORY_FORMATS).cast("string").alias("is")).collect()
    assert [r["is"] for r in found] == [r["want"] for r in found]
    assert sum(r["is"] is not None for r in found) >= 6
    plan = catalog.queries()["amcache_rows"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 3 and plan.count("RLIKE") == 3
