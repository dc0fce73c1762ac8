"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file (shard) has, one after the other: the magic, the ids of its documents
(2 bytes an id where the vocabulary allows, else 4, little-endian), the
Elias-Fano coded boundaries (document i owns ids select(i) to select(i + 1)), the
Elias-Fano coded document ids (each less the smallest), a footer with the section
lengths, the footer's length and the magic again. No table of 64-bit offsets is kept.

Shards are ordered ranges of the document id, written by Spark's tasks into the
shared folder: first under a name of the attempt, then moved, so that a task that
runs again after a lost executor leaves one whole file with the same content.

Defined results: a null or empty text is the end id alone; null document ids come
first; rows with the same id follow each other, ordered by text; an empty table
writes no shard and reads back as no rows; further columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope.llm.eliasfano import EliasFano, encode
from chronoscope.llm.encoder import WordEncoder
from chronoscope.llm.packing import ENCODE_BYTES
from chronoscope.llm.shared import plain, scratch_path, slices, tidy

MAGIC = b"CHTOK001"
#: Ids that a reader holds at a time.
READ_IDS = 4 << 20

SHARDS = "shard long, path string, n_docs long, n_ids long, bytes long"


def open_folder(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path there."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; ids go out as they come, only a count for each document is held."""

    def __init__(self, folder: str, name: str, attempt: int, id_bytes: int):
        self.files, self.root = open_folder(folder)
        self.final, self.partial = f"{self.root}/{name}", f"{self.root}/_{name}.{attempt}"
        self.dtype = np.dtype(f"<u{id_bytes}")
        self.out = self.files.open_output_stream(self.partial)
        self.out.write(MAGIC)
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(self.dtype).tobytes())
        self.counts.append(counts)
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().to_numpy(zero_copy_only=False))

    def close(self) -> dict:
        counts, doc_ids = np.concatenate(self.counts), np.concatenate(self.doc_ids)
        base = int(doc_ids[0]) if len(doc_ids) else 0
        bounds = encode(np.concatenate([[0], np.cumsum(counts)]))
        coded = encode(doc_ids.astype(np.uint64) - np.uint64(base % (1 << 64)))
        footer = json.dumps({"docs": len(counts), "ids": int(counts.sum()), "id_bytes": self.dtype.itemsize, "nulls": self.nulls, "base": base, "bounds": len(bounds), "doc_ids": len(coded)}).encode()
        for part in (bounds, coded, footer, len(footer).to_bytes(4, "little"), MAGIC):
            self.out.write(part)
        size = self.out.tell()
        self.out.close()
        if self.files.get_file_info(self.final).type != FileType.NotFound:
            self.files.delete_file(self.final)
        self.files.move(self.partial, self.final)
        return {"n_docs": len(counts), "n_ids": int(counts.sum()), "bytes": size}


class ShardReader:
    """A shard's documents; boundaries come from the select structure, ids by ranges of the file."""

    def __init__(self, folder: str, name: str):
        files, root = open_folder(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        length = int.from_bytes(tail[:4], "little")
        foot = json.loads(self.file.read_at(length, size - 12 - length))
        self.docs, self.n_ids, self.nulls, self.base = foot["docs"], foot["ids"], foot["nulls"], foot["base"]
        self.dtype = np.dtype(f"<u{foot['id_bytes']}")
        at = size - 12 - length - foot["doc_ids"]
        self.coded_ids = EliasFano(self.file.read_at(foot["doc_ids"], at))
        self.bounds = EliasFano(self.file.read_at(foot["bounds"], at - foot["bounds"]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the shard."""
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, len(MAGIC) + start * width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's document i."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_ids(self, start: int, stop: int) -> pa.Array:
        """The document ids of documents start to stop - 1."""
        nulls = max(0, min(stop, self.nulls) - start)
        found = self.coded_ids.range(max(0, start - self.nulls), max(0, stop - self.nulls)) + self.base
        return pa.array([None] * nulls + found.tolist(), pa.int64())

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1) -> DataFrame:
    """Writes every document's ids, and ``end_id`` after each, in ascending id order; a row of SHARDS for each file."""
    text = F.col(text_column)
    ordered = docs.select(F.col(id_column).cast("long").alias("d"), text.alias("t")).repartitionByRange("d", F.xxhash64("t")).sortWithinPartitions("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        number = context.partitionId()
        coder = WordEncoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "t", ENCODE_BYTES):
                if writer is None:
                    writer = ShardWriter(folder, f"shard-{number:08d}.tok", context.taskAttemptId(), 2 if coder.size <= 1 << 16 else 4)
                ids, bounds = coder.encode(plain(part.column("t")))
                writer.add(part.column("d"), np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1)
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"shard-{number:08d}.tok"} | writer.close()], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    ordered.mapInArrow(tidy(run), SHARDS).write.parquet(f"{folder}/manifest")
    return shards(docs.sparkSession, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, a row for each."""
    return spark.read.schema(SHARDS).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files.

    The running total over shards is a window over the manifest alone: one row a file."""
    manifest = shards(spark, folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(folder, row["path"])
                at = 0
                while at < reader.docs:
                    bounds = reader.bounds.range(at, min(reader.docs, at + (1 << 16)) + 1)
                    many = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
                    bounds = bounds[: many + 1]
                    data = memoryview(reader.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")).cast("B")
                    cuts = ((bounds - bounds[0]) * 4).tolist()
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([reader.doc_ids(at, at + many), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += many
                reader.close()

    return placed.repartition(max(1, manifest.count())).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the documents' token files and reads them back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer)
    return read_token_files(spark, folder)
