"""Small decoders of artifact bytes and texts.

A decoder is a function from one file's bytes to rows; ``decoded`` runs it in the
tasks that hold the bytes and keeps what fails as error rows, so one bad file
never stops a job. Everything after the bytes is column expressions.

Journals, logs and SQLite files have no bound on their size: their decoders read an
open file in chunks (``..._stream``), and rows leave a task in batches."""

from __future__ import annotations

import codecs
import io
import re
import shutil
import struct
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows that leave a decoder together; bytes that a stream decoder reads at a time.
BATCH_ROWS, CHUNK = 8192, 4 << 20
#: What a damaged file or archive entry raises.
DAMAGE = (ValueError, struct.error, IndexError, UnicodeDecodeError, OverflowError)


def batches_of(rows: Iterator[tuple], head: dict, names: list[str], arrow: pa.Schema, damage: tuple = DAMAGE) -> Iterator[pa.RecordBatch]:
    """One file's rows in batches of bounded size, and a row with the error where it fails."""
    out = []
    try:
        for k, row in enumerate(rows):
            out.append(head | {"rec_ord": k, "error": None} | dict(zip(names, row)))
            if len(out) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
    except damage as error:
        out.append(head | {"rec_ord": None, "error": f"{type(error).__name__}: {error}"} | dict.fromkeys(names))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


def decoded_schema(own: list, schema: str | T.StructType) -> tuple[T.StructType, list[str]]:
    """The schema of decoded rows of files with these fields, and the names of the decoder's columns."""
    extra = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)  # noqa: SLF001
    return T.StructType([*own, T.StructField("rec_ord", T.LongType()), *extra.fields, T.StructField("error", T.StringType())]), extra.names


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str | T.StructType, content: str = "content") -> DataFrame:
    """files without their bytes, rec_ord, the decoder's columns and ``error``; a file that fails gives one row with its error."""
    own = T.StructType([f for f in files.schema.fields if f.name != content])
    out, names = decoded_schema(own.fields, schema)
    arrow = to_arrow_schema(out)

    def rows_of(data: bytes | None) -> Iterator[tuple]:
        if data is None:
            raise ValueError("no content")
        yield from decode(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head = {n: batch.column(n)[i].as_py() for n in own.names}
                yield from batches_of(rows_of(batch.column(content)[i].as_py()), head, names, arrow)

    return files.mapInArrow(run, out)


def utf16(data: bytes) -> str:
    """Little-endian UTF-16 up to the first NUL."""
    return data.decode("utf-16-le", "replace").split("\0", 1)[0]


def positive(value: int) -> int | None:
    """A 64-bit number, null where a signed column can't hold it."""
    return value if value < 1 << 63 else None


# Change journal

USN = "entry long, sequence int, parent long, parent_sequence int, usn long, ticks long, reason long, attributes long, name string"
CLOSE = 0x80000000
#: A record's head, name offset and name end lie in this many bytes from its beginning.
RECORD_BYTES = 1 << 18
NOT_ZERO = re.compile(rb"[^\0]")


def usn_records(data: bytes) -> Iterator[tuple]:
    """Version 2 and 3 records; zero stretches are skipped, records that only say CLOSE are left out."""
    return usn_stream(io.BytesIO(data), len(data))


def usn_stream(file: IO[bytes], size: int) -> Iterator[tuple]:
    """The rows of usn_records from an open file of any size."""
    return (row[1:] for row in JournalWalk(file, size))


class JournalWalk:
    """A walk over a journal's records from a place up to another: (place, *row of USN) of each.

    It visits every record that begins before ``stop``; ``place`` is then the first byte that it hasn't visited."""

    def __init__(self, file: IO[bytes], size: int, start: int = 0, stop: int | None = None):
        self.file, self.size, self.place, self.stop = file, size, start, size if stop is None else stop

    def __iter__(self) -> Iterator[tuple]:
        file, size = self.file, self.size
        place, data, base = self.place, b"", self.place  # data begins at base
        if place:
            file.seek(place)
        while place + 60 <= size and place < self.stop:
            if min(size, place + RECORD_BYTES) > base + len(data):
                skip = place - base - len(data)
                data = data[place - base :] if skip <= 0 else b""
                while skip > 0:
                    if not (passed := len(file.read(min(skip, CHUNK)))):
                        raise ValueError("shorter than its size")
                    skip -= passed
                data, base = data + file.read(CHUNK), place
            at = place - base
            length, major = struct.unpack_from("<IH", data, at)
            if not 60 <= length <= size - place or major not in (2, 3):
                found = NOT_ZERO.search(data, at)
                place += max(8, ((found.start() if found else len(data)) - at) // 8 * 8)
                self.place = place
                continue
            wide = 16 if major == 3 else 0
            if length >= 60 + wide:
                entry = int.from_bytes(data[at + 8 : at + 16], "little")
                parent = int.from_bytes(data[at + 16 + wide // 2 : at + 24 + wide // 2], "little")
                usn, ticks, reason, _, _, attributes, name_size, start = struct.unpack_from("<qQIIIIHH", data, at + 24 + wide)
                if reason != CLOSE and start + name_size <= length:
                    low = (1 << 48) - 1
                    yield place, entry & low, entry >> 48, parent & low, parent >> 48, usn, positive(ticks), reason, attributes, data[at + start : at + start + name_size].decode("utf-16-le", "replace")
            place += -(-length // 8) * 8
            self.place = place


# Log file

PAGE = 4096
LOG_PAGES = "page_no long, kind string, lsn long, clients int"


def log_pages(data: bytes) -> Iterator[tuple]:
    """A row for each page: its kind by its first four bytes (RSTR, RCRD, zero, other) and the LSN and number of clients of a restart area, which the first two pages have."""
    return log_stream(io.BytesIO(data), len(data))


def log_stream(file: IO[bytes], size: int) -> Iterator[tuple]:
    """The rows of log_pages from an open file of any size."""
    return log_range(file, size, 0, size)


def log_range(file: IO[bytes], size: int, start: int, stop: int) -> Iterator[tuple]:
    """The rows of log_pages for the pages that begin from ``start``, which is a page's place, up to ``stop``."""
    if start:
        file.seek(start)
    for number in range(start // PAGE, -(-stop // PAGE) if stop < size else (size + PAGE - 4) // PAGE):  # the last page may be cut short
        page = file.read(PAGE)
        kind = page[:4].decode("latin-1") if page[:4] in (b"RSTR", b"RCRD") else "other" if any(page[:4]) else "zero"
        lsn = clients = None
        if kind == "RSTR" and number < 2 and len(page) == PAGE:
            at = int.from_bytes(page[24:26], "little")
            if at + 10 <= PAGE:
                lsn, clients = positive(int.from_bytes(page[at : at + 8], "little")), int.from_bytes(page[at + 8 : at + 10], "little")
        yield number, kind, lsn, clients


#: Pages of a segment of a log, which one task summarises.
SEGMENT_PAGES = 1 << 14


def page_segments(pages: DataFrame, file: str = "file", segment_pages: int = SEGMENT_PAGES) -> DataFrame:
    """(file, segment, summary) of stretches of pages: what a stretch says of gaps, whatever stretches are before and after it.

    A summary has the kinds of its first and last page, whether it has a record page, an odd page, and a zero page
    that lies between record pages (``gap``), and whether, were there a record page before, one of its zero pages would (``gap_after``)."""
    order = Window.partitionBy(file, "segment").orderBy("page_no")
    zero, record = F.col("kind") == "zero", F.col("kind") == "RCRD"
    cut = pages.select(file, F.floor(F.col("page_no") / segment_pages).alias("segment"), "page_no", "kind")
    marked = cut.select(
        file, "segment", "page_no", "kind", (zero & F.coalesce(F.lead("kind").over(order) == "RCRD", F.lit(False))).alias("turn"), (F.count_if(record).over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias("seen")
    )
    summary = F.struct(
        F.min_by("kind", "page_no").alias("first"), F.max_by("kind", "page_no").alias("last"), F.bool_or(record).alias("record"),
        F.bool_or(~F.col("kind").isin("RCRD", "zero")).alias("odd"), F.bool_or(F.col("turn") & F.col("seen")).alias("gap"), F.bool_or("turn").alias("gap_after"),
    )
    return marked.groupBy(file, "segment").agg(summary.alias("summary"))


def joined_summaries(a: Column, b: Column) -> Column:
    """The summary of a stretch and the one that follows it. Joining is associative, so stretches may be joined in any grouping."""
    border = (a["last"] == "zero") & (b["first"] == "RCRD")
    return F.struct(
        a["first"].alias("first"), b["last"].alias("last"), (a["record"] | b["record"]).alias("record"), (a["odd"] | b["odd"]).alias("odd"),
        (a["gap"] | b["gap"] | a["record"] & (b["gap_after"] | border)).alias("gap"), (a["gap_after"] | b["gap_after"] | border).alias("gap_after"),
    )


def page_gaps(pages: DataFrame, file: str = "file", segment_pages: int = SEGMENT_PAGES) -> DataFrame:
    """(file, gap): whether a file has a page that is neither record nor zero, or a zero page between record pages.

    Segments of a file are summarised by tasks of their own; a file's summaries, a row for 64 MiB of it, are joined in order."""
    segments = F.array_sort(F.collect_list(F.struct("segment", "summary")))
    found = page_segments(pages, file, segment_pages).groupBy(file).agg(segments.alias("parts"))
    whole = F.reduce(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.element_at("parts", 1)["summary"], lambda a, x: joined_summaries(a, x["summary"]))
    return found.select(file, whole.alias("whole")).select(file, (F.col("whole.odd") | F.col("whole.gap")).alias("gap"))


def log_summary(pages: DataFrame, file: str = "file", segment_pages: int = SEGMENT_PAGES) -> DataFrame:
    """(file, record_pages, max_lsn, gap); record pages and gaps count from page 2."""
    counts = pages.groupBy(file).agg(F.count_if((F.col("kind") == "RCRD") & (F.col("page_no") >= 2)).alias("record_pages"), F.max("lsn").alias("max_lsn"))
    return counts.join(page_gaps(pages.where("page_no >= 2"), file, segment_pages), file, "left").withColumn("gap", F.coalesce("gap", F.lit(False)))


# Shortcuts, recycle bin

LNK = "created long, accessed long, written long, size long, target string, machine string, mac string"
LINK_HEAD = bytes.fromhex("4c0000000114020000000000c000000000000046")


def link(data: bytes) -> Iterator[tuple]:
    """One row: the target's times and size, its path, and the tracker block's machine and MAC address."""
    data = memoryview(data)
    if data[:20] != LINK_HEAD or len(data) < 76:
        raise ValueError("not a shortcut")
    flags = int.from_bytes(data[20:24], "little")
    created, accessed, written, size = struct.unpack_from("<QQQI", data, 28)
    at, target, relative = 76, None, None
    if flags & 1:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    if flags & 2:
        length, head, kind, _, base = struct.unpack_from("<IIIII", data, at)
        if kind & 1 and base < length:
            target = bytes(data[at + base : at + length]).split(b"\0", 1)[0].decode("latin-1")
        at += length
    for bit in (4, 8, 16, 32, 64):  # name, relative path, folder, arguments, icon
        if flags & bit:
            wide = 2 if flags & 128 else 1
            end = at + 2 + wide * int.from_bytes(data[at : at + 2], "little")
            if bit == 8:
                relative = bytes(data[at + 2 : end]).decode("utf-16-le" if wide == 2 else "latin-1", "replace")
            at = end
    machine = mac = None
    while at + 8 <= len(data):
        length, signature = struct.unpack_from("<II", data, at)
        if length < 8:
            break
        if signature == 0xA0000003 and length >= 96:
            machine = bytes(data[at + 16 : at + 32]).split(b"\0", 1)[0].decode("latin-1")
            mac = ":".join(f"{x:02x}" for x in data[at + 90 : at + 96])
        at += length
    yield positive(created), positive(accessed), positive(written), size, target or relative, machine, mac


CUSTOM_LINKS = f"offset long, {LNK}"


def custom_links(data: bytes) -> Iterator[tuple]:
    """The place and row of every shortcut within a custom jump list; what looks like one and isn't is passed over."""
    whole, at = memoryview(data), data.find(LINK_HEAD)
    while at >= 0:
        try:
            yield from ((at, *row) for row in link(whole[at:]))
        except DAMAGE:
            pass
        at = data.find(LINK_HEAD, at + 76)


RECYCLED = "version long, size long, ticks long, path string"


def recycled(data: bytes) -> Iterator[tuple]:
    """The one row of a recycle bin's index file of version 1 or 2."""
    if not 28 <= len(data) <= 1 << 20:
        raise ValueError("no index file by its size")
    version, size, ticks = struct.unpack_from("<QQQ", data)
    if version == 1:
        path = utf16(data[24:544])
    elif version == 2:
        path = utf16(data[28 : 28 + 2 * int.from_bytes(data[24:28], "little")])
    else:
        raise ValueError(f"unknown version {version}")
    yield version, positive(size), positive(ticks), path


# Management repository

WMI = "offset long, class string, context string"
# Names that mark persistence, and the bytes before and after one that are looked at.
WMI_MARKS = {b"CommandLineEventConsumer": "CommandLineEventConsumer", b"ActiveScriptEventConsumer": "ActiveScriptEventConsumer", b"__EventFilter": "__EventFilter", b"_FilterToConsumerBinding": "__FilterToConsumerBinding"}
WMI_BEFORE, WMI_AFTER = 256, 512
WMI_MARK = re.compile(rb"CommandLineEventConsumer|ActiveScriptEventConsumer|(?<!_)__EventFilter|_FilterToConsumerBinding")
UNPRINTABLE = bytes(x if 32 <= x < 127 else 46 for x in range(256))


def wmi_stream(file: IO[bytes], size: int) -> Iterator[tuple]:
    """A row for each mark of persistence in a repository of any size, with the text around it; dots stand for bytes that aren't printable."""
    longest, data, base, at, more = max(map(len, WMI_MARKS)), b"", 0, 0, True  # data begins at base; marks before at are done
    while more:
        more = file.read(CHUNK)
        data += more
        end = len(data) - (WMI_AFTER if more else 0)
        for mark in WMI_MARK.finditer(data, at - base):
            if mark.start() > end:
                break
            around = data[max(0, mark.start() - WMI_BEFORE) : mark.start() + WMI_AFTER]
            yield base + mark.start(), WMI_MARKS[mark[0]], around.translate(UNPRINTABLE).decode("ascii")
            at = base + mark.end()
        at = max(at, base + end - longest) if more else at
        cut = max(0, at - base - WMI_BEFORE - 1)
        data, base = data[cut:], base + cut


def wmi_entries(marks: DataFrame) -> DataFrame:
    """marks (class, context) with name and details, read from the text around."""
    def after(head: str, stop: str, most: int) -> Column:
        """The trimmed text behind a head up to a stop, or so many characters where none follows."""
        pattern = rf"{head}(?:([^{stop}]*+)[{stop}]|([^{stop}]{{0,{most}}}))"
        return F.trim(F.concat(*(F.regexp_extract("context", pattern, i) for i in (1, 2))))

    def value(keyword: str) -> Column:
        text = after(rf'{keyword}[=" .]*', '"', 256)
        return F.when(text != "", F.concat(F.lit(f"{keyword}: "), text))

    name, details = F, F
    for mark, kind in WMI_MARKS.items():
        name = name.when(F.col("class") == kind, after(rf'{mark.decode()}.*?Name[=" .]*', '".', 128))
    details = details.when(F.col("class") == "CommandLineEventConsumer", F.coalesce(value("CommandLineTemplate"), value("ExecutablePath")))
    details = details.when(F.col("class") == "ActiveScriptEventConsumer", F.coalesce(value("ScriptText"), value("ScriptingEngine"), value("ScriptFileName")))
    details = details.when(F.col("class") == "__EventFilter", after("(?=SELECT)", '"', 256))
    details = details.otherwise(F.concat_ws(" -> ", *(F.nullif(after(f"(?={keyword})", '".', 128), F.lit("")) for keyword in ("Consumer", "Filter"))))
    return marks.withColumns({"name": F.when(name != "", name).otherwise("Unknown"), "details": F.coalesce(details, F.lit(""))})


# Texts and column-only artifacts


def text_lines(files: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line_no, line): non-blank lines, trimmed, numbered from 1."""
    lines = files.select(*keep, F.posexplode(F.split(text, "\n")).alias("n", "raw"))
    trimmed = F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "")
    return lines.select(*keep, (F.col("n") + 1).cast("int").alias("line_no"), trimmed.alias("line")).where("line <> ''")


def rdp_cache(files: DataFrame, content: str = "content") -> DataFrame:
    """kind and tiles of bitmap cache files of at least 16 bytes."""
    head = F.decode(F.substring(content, 1, 4), "ISO-8859-1")
    size = F.octet_length(content)
    return files.where(size >= 16).withColumns(bitmap_columns(head, size)).drop(content)


def bitmap_columns(head: Column, size: Column) -> dict[str, Column]:
    """kind and tiles of a bitmap cache by its first four signs and its size."""
    kind = F.when(head == "RDP8", "RDP8").when(head == "RDP6", "RDP6").otherwise("Unknown")
    return {"kind": kind, "tiles": F.greatest(F.lit(1), F.floor(size / 16384)).cast("long")}


BITMAP_HEAD = "head string"


def bitmap_head(file: IO[bytes], size: int) -> Iterator[tuple]:
    """The first four bytes of a bitmap cache of any size; none for one of fewer than 16 bytes."""
    if len(start := file.read(16)) == 16:
        yield (start[:4].decode("latin-1"),)


#: What counts as white space around a command: Unicode's, and nothing else.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINES = "line_no int, line string"


def encoding_of(head: bytes) -> str:
    """The encoding that a text's first bytes name, UTF-8 where they name none."""
    return {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(head[:2], "utf-8")


def lines_stream(file: IO[bytes], size: int) -> Iterator[tuple]:
    """Non-blank lines of a text of any size, trimmed, numbered from 1; bytes that its encoding doesn't have become U+FFFD."""
    buffered = io.BufferedReader(file) if not isinstance(file, io.BufferedIOBase) else file
    head = buffered.read(2)
    encoding = encoding_of(head)
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    number, rest = 0, decoder.decode(b"" if encoding != "utf-8" else head)
    while True:
        more = buffered.read(CHUNK)
        lines = (rest + decoder.decode(more, not more)).split("\n")
        rest = lines.pop() if more else ""
        for line in lines:
            number += 1
            if line := line.strip(WHITE):
                yield number, line
        if not more:
            return


def text_of(data: bytes) -> str:
    """A text by its byte order mark, or as UTF-8; bytes that its encoding doesn't have become U+FFFD."""
    encoding = encoding_of(data)
    return data[2:].decode(encoding, "replace") if encoding != "utf-8" else data.decode("utf-8", "replace").removeprefix("\ufeff")


TASK = "author string, uri string, date_text string, command string, arguments string"


def task(data: bytes) -> Iterator[tuple]:
    """The one row of a task definition with an action: its registration, and the first command or, as ``COM:<id>``, the first handler.

    Names count without their namespace. A definition that ends early gives what it has; one whose XML is broken fails."""
    from xml.parsers import expat

    path: list[str] = []
    texts: dict[str, str] = {}
    actions: list[dict[str, str]] = []

    def start(name: str, _: dict) -> None:
        path.append(name.rpartition(":")[2])
        if path[-1] in ("Exec", "ComHandler") and "Actions" in path:
            actions.append({})

    def end(_: str) -> None:
        path.pop()

    def characters(text: str) -> None:
        name = path[-1] if path else ""
        if name in ("Date", "Author", "URI") and "RegistrationInfo" in path:
            texts[name] = texts.get(name, "") + text
        elif (name in ("Command", "Arguments") and "Exec" in path or name == "ClassId" and "ComHandler" in path) and actions:
            actions[-1][name] = actions[-1].get(name, "") + text

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", text_of(data)).encode("utf-8", "replace"), True)
    except expat.ExpatError as error:
        if error.code != expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS]:
            raise ValueError(f"broken XML: {error}") from error
    for action in actions:
        found = {k: v.strip(WHITE) for k, v in action.items()}
        command = found.get("Command") or (f"COM:{found['ClassId']}" if found.get("ClassId") else None)
        if command:
            yield tuple(texts.get(x, "").strip(WHITE) for x in ("Author", "URI", "Date")) + (command, found.get("Arguments"))
            return


def task_columns() -> dict[str, Column]:
    """date and action from the columns of TASK."""
    return {
        "date": F.try_to_timestamp(F.substring("date_text", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        "action": F.when(F.col("arguments") != "", F.concat_ws(" ", "command", "arguments")).otherwise(F.col("command")),
    }


def scheduled_task(files: DataFrame, xml: str = "xml") -> DataFrame:
    """author, uri, date and action of task definitions that have an action, and ``error`` (null but for broken ones)."""
    found = decoded(files.withColumn(xml, F.col(xml).cast("binary")), task, TASK, content=xml)
    return found.withColumns(task_columns()).drop("rec_ord", "date_text", "command", "arguments")


EVENT_XML = "System struct<Provider struct<_Name string>, EventID struct<_VALUE string>, TimeCreated struct<_SystemTime string>, Channel string, Computer string>, EventData struct<Data array<struct<_Name string, _VALUE string>>>, UserData struct<Data array<struct<_Name string, _VALUE string>>>"


def event_records(files: DataFrame, xml: str = "xml") -> DataFrame:
    """event_id, channel, provider, computer, event_data and time (text) of event-log records as XML, as ``normalize.event_log`` takes them.

    Names count without their namespace; of fields of one name the last has its value; records without id or time, and broken ones, are left out."""
    record = F.from_xml(xml, EVENT_XML, {"ignoreNamespace": "true"})
    empty = F.array().cast("array<struct<_Name string, _VALUE string>>".replace(" string", ":string"))
    found = files.withColumn("_record", record)
    items = F.filter(F.concat(*(F.coalesce(F.col(f"_record.{part}.Data"), empty) for part in ("EventData", "UserData"))), lambda x: (x["_Name"] != "") & x["_VALUE"].isNotNull())
    found = found.withColumn("_items", items)
    last = F.filter("_items", lambda x, i: ~F.exists(F.slice("_items", i + 2, F.size("_items")), lambda y: y["_Name"] == x["_Name"]))
    system = "_record.System"
    fields = {
        "event_id": F.trim(F.col(f"{system}.EventID._VALUE")).try_cast("long"),
        "channel": F.coalesce(F.col(f"{system}.Channel"), F.lit("")),
        "provider": F.coalesce(F.col(f"{system}.Provider._Name"), F.lit("")),
        "computer": F.coalesce(F.col(f"{system}.Computer"), F.lit("")),
        "event_data": F.map_from_entries(last),
        "time": F.col(f"{system}.TimeCreated._SystemTime"),
    }
    return found.withColumns(fields).where("event_id is not null and time is not null").drop("_record", "_items", xml)


# SQLite histories. A database is opened from a copy in the task's own temporary folder.

HISTORY = "url string, title string, visit_count long, visit long"
ACTIVITY = "app_id string, activity long, start long, end long"
# The tables of the three formats.
CHROMIUM_SQL = "select u.url, u.title, u.visit_count, v.visit_time from visits v join urls u on u.id = v.url order by v.visit_time desc, v.id desc limit ?"
FIREFOX_SQL = "select p.url, p.title, p.visit_count, v.visit_date from moz_historyvisits v join moz_places p on p.id = v.place_id order by v.visit_date desc, v.id desc limit ?"
ACTIVITY_SQL = "select AppId, ActivityType, StartTime, EndTime from Activity order by StartTime desc, rowid desc limit ?"
#: Rows that are taken from one database, the latest first.
MOST_ROWS = 10_000


def sqlite_rows(sql: str, most: int | None = MOST_ROWS) -> Callable[[bytes], Iterator[tuple]]:
    """A decoder of a SQLite file's bytes by one query with a row limit."""
    return lambda data: sqlite_stream(sql, most)(io.BytesIO(data), len(data))


def sqlite_stream(sql: str, most: int | None = MOST_ROWS) -> Callable[[IO[bytes], int], Iterator[tuple]]:
    """sqlite_rows from an open file of any size; all rows with ``most`` None. Rows leave as the database gives them."""

    def decode(source: IO[bytes], size: int) -> Iterator[tuple]:
        import sqlite3
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".db") as file:
            shutil.copyfileobj(source, file, CHUNK)
            file.flush()
            try:
                with sqlite3.connect(f"file:{file.name}?mode=ro", uri=True) as db:
                    db.text_factory = lambda b: b.decode("utf-8", "replace")
                    yield from db.execute(sql, (-1 if most is None else most,))  # -1: no limit
            except sqlite3.Error as error:
                raise ValueError(str(error)) from error

    return decode
