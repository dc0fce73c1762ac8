"""What several corpus operators use: tables in the shared folder, Arrow slices, table access."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope.operators.settled import shared_folder

#: Text bytes that a Python task works on at a time: what it holds meanwhile is some 60 times that.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    _scratch.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_mark() -> int:
    """How many paths this driver has taken so far, for ``remove_scratch``."""
    return len(_scratch)


def remove_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes what this driver wrote to the shared folder since a mark, but for the last ``keep`` paths, and says how many paths that were.

    For the end of a job or step: DataFrames that operators returned read from there until they are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stop = max(since, len(_scratch) - keep)
    old, _scratch[since:stop] = _scratch[since:stop], []
    paths = [jvm.org.apache.hadoop.fs.Path(x) for x in old]
    return sum(bool(path.getFileSystem(conf).delete(path, True)) for path in paths)


#: Spark's setting that a statement's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, what a statement shuffled is deleted at its end. The session's own setting comes back afterwards."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, readable by every executor, lineage cut.

    Nothing reads its shuffle files again, so they go at once."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more: what came of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        for path in [x for x in _scratch if any(f"/{x.rpartition('/')[2]}/" in file for file in table.inputFiles()[:1])]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            _scratch.remove(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """name, with as many signs after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_scan(df: DataFrame) -> bool:
    """Whether df is columns of whole Parquet files, so that a row's place in its file tells how many rows are before it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return hasattr(relation, "fileFormat") and relation.getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in relation.fileFormat().toString()


#: Input files of which a row each is sent to all tasks; with more, Spark chooses how to join them.
MOST_SENT_FILES = 100_000


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column ``name``: the rows' numbers, from 0 without gaps, in the order of the files and of the rows in each.

    The numbers follow from the files alone, so every use of the result gives a row the
    same one, however the files are cut into tasks and whichever executors are lost.
    What isn't whole Parquet files (a filter, another format, a join) is written first. Only rows of each
    file are counted; nothing is sorted but the files' names, of which the driver's own listing has one each."""
    if not is_scan(docs):
        docs = written(docs, "numbered")
    meta = docs.metadataColumn("_metadata")
    path, place = unused(docs, "order_file"), unused(docs, "order_row")
    at = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    earlier = Window.orderBy(F.length(path), path).rowsBetween(Window.unboundedPreceding, -1)  # a part's number may have more digits
    files = at.groupBy(path).agg(F.count("*").alias("n")).select(path, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    files = F.broadcast(files) if len(docs.inputFiles()) <= MOST_SENT_FILES else files
    return at.join(files, path).select(*(F.col(quoted(c)) for c in docs.columns), (F.col("base") + F.col(place)).alias(name))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives its memory back to the system when the task ends, since workers are used again."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One chunk of 32-bit-offset strings, null as the empty string."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.string()).fill_null("")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each; a longer text makes a run alone."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    sizes = np.frombuffer(pc.binary_length(text).fill_null(0).cast(pa.int64()).buffers()[1], np.int64)[: len(text)]
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most ``most`` of them, without a sort of all.

    Counts are summed up by 64 steps a doubling, so a few thousand rows show from
    which step on there are at most ``most``; rows of the step that would be too many stay out."""
    step = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("int")
    many = 0
    least = None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        many += row["count"]
        if many > most:
            break
        least = row["step"]
    return counts.limit(0) if least is None else counts.where(step >= least)
