"""A collection: its paths, what they are, and their bytes.

Paths become a manifest DataFrame (one row a file) by column expressions; bytes are
read by tasks, from a ZIP archive or a folder that all of them see, or with Spark's
binaryFile source from any other store."""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from types import SimpleNamespace
from typing import BinaryIO
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.functions.text import username


def percent_decoded(path: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus; what isn't UTF-8 is null (decoding marks it with U+FFFD)."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    meant = F.upper(path).contains("%EF%BF%BD") | path.contains("\ufffd")
    return F.when(~decoded.contains("\ufffd") | meant, decoded)


def windows_path(original: Column) -> Column:
    r"""``uploads/ntfs/%5C%5C.%5CC%3A/x`` and ``uploads/auto/C%3A/x`` as ``C:\x``; null for every other path."""
    decoded = percent_decoded(original)
    ntfs = F.regexp_extract(decoded, r"^uploads/ntfs/\\\\\.\\C:/(.*)$", 1)
    auto = F.regexp_extract(decoded, r"^uploads/auto/(.+)$", 1)
    inside = F.when(decoded.rlike(r"^uploads/ntfs/\\\\\.\\C:/"), F.concat(F.lit("C:\\"), ntfs)).when(auto != "", auto)
    return F.translate(inside, "/", "\\")


def accessor(original: Column) -> Column:
    return F.when(original.startswith("uploads/ntfs/"), "Ntfs").when(original.startswith("uploads/auto/"), "Auto")


# Artifact classes in the order in which they are tried. All parts are compared in lower case:
# (class, hive, [path ends of which one is needed], [parts that are all needed], [parts of which one is needed])
CLASSES = [
    ("mft", None, [r"\$mft"], [], []),
    ("mftmirr", None, [r"\$mftmirr"], [], []),
    ("usnjrnl_j", None, ["$usnjrnl:$j"], [], []),
    ("usnjrnl_max", None, ["$usnjrnl:$max"], [], []),
    ("logfile", None, [r"\$logfile"], [], []),
    ("boot", None, [r"\$boot"], [], []),
    ("secure_sds", None, ["$secure:$sds"], [], []),
    ("evtx", None, [".evtx"], [], []),
    ("prefetch", None, [".pf"], ["prefetch"], []),
    ("lnk", None, [".lnk"], [], []),
    ("jumplist_auto", None, [".automaticdestinations-ms"], [], []),
    ("jumplist_custom", None, [".customdestinations-ms"], [], []),
    ("amcache", "Amcache", ["amcache.hve"], [], []),
    ("registry", "System", [r"\system"], ["config"], []),
    ("registry", "Software", [r"\software"], ["config"], []),
    ("registry", "Sam", [r"\sam"], ["config"], []),
    ("registry", "Security", [r"\security"], ["config"], []),
    ("registry", "Default", [r"\default"], ["config"], []),
    ("registry", "NtUser", ["ntuser.dat"], [], []),
    ("registry", "UsrClass", ["usrclass.dat"], [], []),
    ("recycle_bin", None, [], ["$recycle.bin", "$i"], []),
    ("scheduled_task", None, [], [r"system32\tasks" + "\\"], []),
    ("srum", None, ["srudb.dat"], [r"\sru" + "\\"], []),
    ("wmi", None, ["objects.data"], [r"\wbem\repository" + "\\"], []),
    ("powershell", None, [], ["consolehost_history.txt"], []),
    ("activities", None, ["activitiescache.db"], [], []),
    ("rdp_cache", None, [".bmc"], [r"\cache" + "\\"], []),
    ("browser", None, ["history", "places.sqlite"], [], ["chrome", "edge", "firefox", "mozilla"]),
]
#: Of these a collection has one; the last path wins.
SINGLE = ("mft", "mftmirr", "usnjrnl_j", "usnjrnl_max", "logfile", "boot", "secure_sds")


def _class_conditions(path: Column) -> list[tuple[str, str | None, Column]]:
    lower = F.lower(path)
    out = []
    for name, hive, ends, parts, some in CLASSES:
        test = F.lit(True)
        if ends:
            end = F.lit(False)
            for e in ends:
                end = end | lower.endswith(e)
            test = test & end
        for p in parts:
            test = test & lower.contains(p)
        if some:
            one = F.lit(False)
            for p in some:
                one = one | lower.contains(p)
            test = test & one
        out.append((name, hive, test))
    return out


def artifact_class(path: Column) -> Column:
    """The class of a Windows path; null where none fits."""
    chosen = F
    for name, _, test in _class_conditions(path):
        chosen = chosen.when(test, name)
    return chosen.otherwise(None)


def hive_type(path: Column) -> Column:
    chosen = F
    for _, hive, test in _class_conditions(path):
        chosen = chosen.when(test, hive)
    return chosen.otherwise(None)


def manifest(paths: DataFrame, original: str = "original_path", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, original_path, windows_path, accessor, artifact_class, hive_type, username) of all usable paths."""
    found = paths.select(F.col(ordinal).alias("ordinal"), F.col(original).alias("original_path"), windows_path(F.col(original)).alias("windows_path"))
    path = F.col("windows_path")
    return found.where(path.isNotNull()).select("*", accessor(F.col("original_path")).alias("accessor"), artifact_class(path).alias("artifact_class"), hive_type(path).alias("hive_type"), username(path).alias("username"))


def path_of(original: str) -> str | None:
    """``windows_path`` of one path, for planning which files to open."""
    try:
        decoded = unquote_to_bytes(original).decode()
    except UnicodeDecodeError:
        return None
    if decoded.startswith("uploads/ntfs/\\\\.\\C:/"):
        return "C:\\" + decoded[len("uploads/ntfs/\\\\.\\C:/") :].replace("/", "\\")
    inside = decoded.removeprefix("uploads/auto/")
    return inside.replace("/", "\\") if inside and inside != decoded else None


def class_of(path: str) -> tuple[str | None, str | None]:
    """``artifact_class`` and ``hive_type`` of one Windows path, for planning which files to open."""
    lower = path.lower()
    for name, hive, ends, parts, some in CLASSES:
        if (not ends or lower.endswith(tuple(ends))) and all(p in lower for p in parts) and (not some or any(p in lower for p in some)):
            return name, hive
    return None, None


def user_of(path: str) -> str:
    """``username`` of one Windows path."""
    found = re.search(r"(?i)(?:^|\\)users\\([^\\]+)", path)
    return found[1] if found else "unknown"


def collection_name(path: str) -> tuple[str, str]:
    """(host, time of collection) from ``Collection-<host>-<time from 202.>``; the time is empty where the name has none, and other names are the host's."""
    name = os.path.basename(path.rstrip("/\\"))
    stem = name if os.path.isdir(path) else os.path.splitext(name)[0]
    if not stem.startswith("Collection-"):
        return stem, ""
    rest = stem.removeprefix("Collection-")
    host, found, time = rest.partition("-202")
    return (host, "202" + time) if found else (rest, "")


def singles(files: DataFrame) -> DataFrame:
    """Of each class that a collection has once, the last file."""
    return files.where(F.col("artifact_class").isin(*SINGLE)).groupBy("artifact_class").agg(F.max_by("windows_path", "ordinal").alias("windows_path"))


class Folder:
    """An unpacked collection, asked in the same words as an archive.

    Files go by name; links aren't followed, since what they point to isn't the collection's."""

    def __init__(self, root: str):
        self.root = root

    def __enter__(self) -> Folder:
        return self

    def __exit__(self, *_) -> None:
        pass

    def _place(self, name: str) -> str:
        return os.path.join(self.root, *name.split("/"))

    def getinfo(self, name: str) -> SimpleNamespace:
        return SimpleNamespace(filename=name, file_size=os.path.getsize(self._place(name)), is_dir=lambda: False)

    def infolist(self) -> list[SimpleNamespace]:
        places = (os.path.join(folder, file) for folder, _, files in os.walk(self.root) for file in files)
        names = sorted(os.path.relpath(x, self.root).replace(os.sep, "/") for x in places if not os.path.islink(x))
        return [self.getinfo(x) for x in names if x == x.encode("utf-8", "replace").decode()]

    def open(self, info: SimpleNamespace) -> BinaryIO:
        return open(self._place(info.filename), "rb")

    def read(self, info: SimpleNamespace) -> bytes:
        with self.open(info) as file:
            return file.read()


def opened(collected: str) -> zipfile.ZipFile | Folder:
    return Folder(collected) if os.path.isdir(collected) else zipfile.ZipFile(collected)


def listing(spark: SparkSession, archive: str) -> DataFrame:
    """(ordinal, original_path, size) of the files of a ZIP archive, of which only the directory is read, or of a folder."""
    with opened(archive) as z:
        rows = [(i, x.filename, x.file_size) for i, x in enumerate(z.infolist()) if not x.is_dir()]
    return spark.createDataFrame(rows, "ordinal long, original_path string, size long")


#: Bits of a file's number for its place in its archive; the archive's place in the list of archives is above them.
FILE_BITS = 32
LISTED = "archive string, host string, collected string, ordinal long, original_path string, size long, whole boolean"


def listings(spark: SparkSession, archives: list[str]) -> DataFrame:
    """The files of many archives and folders, each listed by a task: LISTED, with files numbered in the order of the archives.

    ``whole`` says that a file can only be read from its beginning, as a compressed entry can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, archive in zip(batch.column("n").to_pylist(), batch.column("archive").to_pylist()):
                host, collected = collection_name(archive)
                with opened(archive) as z:
                    files = [(i, x.filename, x.file_size) for i, x in enumerate(z.infolist()) if not x.is_dir()]
                    whole = isinstance(z, zipfile.ZipFile)
                for at in range(0, len(files), 8192):
                    part = files[at : at + 8192]
                    columns = [[archive] * len(part), [host] * len(part), [collected] * len(part), [number << FILE_BITS | i for i, *_ in part], [x[1] for x in part], [x[2] for x in part], [whole] * len(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [part.split()[0] for part in LISTED.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    named = spark.createDataFrame(list(enumerate(archives)), "n long, archive string")
    return named.repartition(max(1, len(archives)), "n").mapInArrow(run, LISTED)


def entry_bytes(files: DataFrame, archive: str | None = None, most: int = (1 << 31) - 1) -> DataFrame:
    """files with their content, read by the tasks from a path that all of them see; null for what is damaged or larger than ``most``, by default what a value of a row can hold.

    The archive is that of the column ``archive`` where none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Opened() as open_archives:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    try:
                        z = open_archives[archive or row.column("archive")[0].as_py()]
                        info = z.getinfo(row.column("original_path")[0].as_py())
                        content = z.read(info) if info.file_size <= most else None
                    except (KeyError, zipfile.BadZipFile, zlib.error, OSError, EOFError):
                        content = None
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "content"])

    from pyspark.sql import types as T

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


class Opened:
    """The archive that a task reads from, kept open until another is asked for."""

    def __init__(self):
        self.name, self.archive = None, None

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        if self.archive is not None:
            self.archive.__exit__(None, None, None)
        self.name = self.archive = None

    def __getitem__(self, name: str) -> zipfile.ZipFile | Folder:
        if name != self.name:
            self.__exit__()
            self.archive, self.name = opened(name), name
        return self.archive


#: What reading an archive's entry raises besides what a decoder does; the first two say that bytes are damaged.
DAMAGED = (zipfile.BadZipFile, zlib.error)
UNREADABLE = (*DAMAGED, KeyError, OSError, EOFError, RuntimeError)


def entry_rows(files: DataFrame, archive: str | None, decode, schema) -> DataFrame:
    """files with rec_ord, the columns of a stream decoder and ``error``, as ``decoders.decoded`` gives them, for entries of any size.

    An entry is read once, by one task, in chunks. What an archive says of an entry's
    checksum is known at its end, so a damaged entry has an error row after rows that
    ``sound`` takes away. Where files have ``offset`` and ``stop``, the decoder is given both."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from chronoscope.sources import decoders

    own = files.schema.names
    out, names = decoders.decoded_schema(files.schema.fields, schema)
    arrow = to_arrow_schema(out)

    def rows_of(z: zipfile.ZipFile | Folder, head: dict) -> Iterator[tuple]:
        info = z.getinfo(head["original_path"])
        with z.open(info) as file:
            yield from decode(file, info.file_size, head["offset"], head["stop"]) if "stop" in head else decode(file, info.file_size)
            while isinstance(z, zipfile.ZipFile) and file.read(decoders.CHUNK):
                pass  # to the end, where the checksum is compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Opened() as open_archives:
            for batch in batches:
                for head in batch.select(own).to_pylist():
                    try:
                        z = open_archives[archive or head["archive"]]
                    except UNREADABLE as error:
                        yield from decoders.batches_of(_failing(error), head, names, arrow, UNREADABLE)
                        continue
                    yield from decoders.batches_of(rows_of(z, head), head, names, arrow, (*decoders.DAMAGE, *UNREADABLE))

    return files.mapInArrow(run, out)


def _failing(error: Exception) -> Iterator[tuple]:
    raise error
    yield


def sound(rows: DataFrame, file: str = "file_ord") -> DataFrame:
    """Decoded rows without those of entries that turned out to be damaged; their error rows stay."""
    kinds = [f"{kind.__name__ if kind.__module__ != 'zlib' else 'error'}:" for kind in DAMAGED]
    damaged = rows.where(F.substring_index("error", " ", 1).isin(*kinds)).select(file).distinct()
    return rows.where("error is null").join(damaged, file, "left_anti").unionByName(rows.where("error is not null"))


def folder_bytes(spark: SparkSession, folder: str, most: int = (1 << 31) - 1) -> DataFrame:
    """(original_path, size, content) of a folder's files; the content of a larger one is null and isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    large = found.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    files = found.where(F.col("length") <= most).select("path", "length", "content").unionByName(large)
    return files.select(F.regexp_replace("path", r"^.*?(?=uploads/)", "").alias("original_path"), F.col("length").alias("size"), "content")
