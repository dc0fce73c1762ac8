"""Collections as a data source: ``spark.read.format("collection").load("/evidence/*.zip")``.

A row is a file of a collection: the collection's host and time, the file's paths, class and
owner, and its bytes. The driver reads the archives' directories alone; a filter on
``artifact_class``, ``host`` or ``archive`` decides there which entries are opened at all. Files
are dealt to tasks by size."""

from __future__ import annotations

import glob
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from chronoscope.sources import collection

#: Name of the format; bytes of files that one task reads, and of a file that is read at all.
FORMAT, PARTITION_BYTES, MOST_BYTES = "collection", 64 << 20, 1 << 30
SCHEMA = "archive string, host string, collected string, ordinal long, original_path string, windows_path string, accessor string, artifact_class string, hive_type string, username string, size long, content binary, error string"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
#: Columns whose filters are answered while the files are listed.
PUSHED = ("archive", "host", "collected", "artifact_class", "hive_type", "username", "accessor")


@dataclass
class Files(InputPartition):
    """Rows, without bytes, of one archive."""

    rows: list[tuple]


def found_archives(path: str) -> list[str]:
    """The archives and collection folders of a pattern or of several, separated by commas, in order."""
    parts = [p.strip() for p in path.split(",") if p.strip()]
    return sorted({x for p in parts for x in (glob.glob(p) or [p])})


def manifest_rows(archive: str) -> list[tuple]:
    """The usable files of an archive: SCHEMA without the bytes and the error."""
    host, collected = collection.collection_name(archive)
    out = []
    with collection.opened(archive) as z:
        for ordinal, info in enumerate(z.infolist()):
            if info.is_dir() or (path := collection.path_of(info.filename)) is None:
                continue
            accessor = "Ntfs" if info.filename.startswith("uploads/ntfs/") else "Auto"
            out.append((archive, host, collected, ordinal, info.filename, path, accessor, *collection.class_of(path), collection.user_of(path), info.file_size))
    return out


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archives = found_archives(options["path"])
        self.content = options.get("content", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.most = int(options.get("maxBytes", MOST_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists on the columns that listing knows; Spark tests all others."""
        for test in filters:
            name = test.attribute[0] if isinstance(test, (EqualTo, In)) and len(test.attribute) == 1 else None
            if name in PUSHED:
                self.wanted.append((name, frozenset([test.value] if isinstance(test, EqualTo) else test.value)))
            else:
                yield test

    def _fits(self, row: tuple) -> bool:
        return all(row[NAMES.index(name)] in values for name, values in self.wanted)

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        with ThreadPoolExecutor(16) as pool:
            for rows in pool.map(manifest_rows, self.archives):
                held, part = 0, []
                for row in filter(self._fits, rows):
                    if part and held + row[-1] > self.partition_bytes and self.content:
                        out.append(Files(part))
                        held, part = 0, []
                    part.append(row)
                    held += row[-1]
                if part:
                    out.append(Files(part))
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "content" else pa.int64() if n in ("ordinal", "size") else pa.string()) for n in NAMES])
        with collection.Opened() as archives:
            for row in partition.rows:
                content = error = None
                if self.content:
                    try:
                        if row[-1] > self.most:
                            raise ValueError(f"larger than {self.most} bytes")
                        z = archives[row[0]]
                        content = z.read(z.getinfo(row[4]))
                    except (ValueError, KeyError, OSError, EOFError, RuntimeError, zipfile.BadZipFile, zlib.error) as failed:
                        error = f"{type(failed).__name__}: {failed}"
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*row, content, error), schema)], schema=schema)


class CollectionSource(DataSource):
    """Options: ``path`` (or load's argument), ``content`` (false leaves the bytes out), ``partitionBytes``, ``maxBytes`` (a larger file has an error instead of bytes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        return CollectionReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(CollectionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
