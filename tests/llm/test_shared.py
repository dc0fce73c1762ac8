import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoscope.llm import shared


@settings(deadline=None)
@given(st.lists(st.text(max_size=20), max_size=30), st.integers(1, 60))
def test_slices_keep_all_rows_in_order(texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or None for t in texts], pa.string())], names=["i", "t"])
    parts = list(shared.slices(batch, "t", most))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("t").to_pylist()) <= most for p in parts)


def test_most_frequent(spark):
    rows = [(i, n) for i, n in enumerate([1000, 900, 500, 500, 20, 20, 20, 3, 2, 2, 1, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "i int, n long")
    for most in range(16):
        found = sorted((r.n for r in shared.most_frequent(counts, "n", most).collect()), reverse=True)
        assert len(found) <= most and found == [n for _, n in rows][: len(found)]
        if len(found) < len(rows):  # only equal counts keep it from more
            rest = [n for _, n in rows][len(found) :]
            assert len(found) + rest.count(rest[0]) > most
    assert shared.most_frequent(counts.limit(0), "n", 5).count() == 0


def test_scratch_tables_go(spark):
    df = shared.written(spark.range(5), "some")
    assert df.count() == 5
    assert shared.remove_scratch(spark) >= 1 and shared.remove_scratch(spark) == 0


def inputs(spark, folder, rows):
    """The same rows in several forms, all of two files or more: filtered, JSON, ORC, by partition columns, a union."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    other = [(900 + i, f"other text number {i} with words", "en", "src9", 1) for i in range(20)]
    mixed = spark.createDataFrame([r for pair in zip(other, [*rows, *other[len(rows) :]]) for r in pair][: 2 * len(rows)], schema)
    mixed.repartition(2).write.mode("overwrite").parquet(f"{folder}/mixed")
    plain = spark.createDataFrame(rows, schema).repartition(2)
    for kind in ("json", "orc", "parquet"):
        plain.write.mode("overwrite").format(kind).save(f"{folder}/{kind}")
    plain.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/parts")
    yield "filter", spark.read.parquet(f"{folder}/mixed").where("doc_id < 900")
    for kind in ("json", "orc", "parquet"):
        yield kind, spark.read.schema(schema).format(kind).load(f"{folder}/{kind}")
    yield "partition columns", spark.read.parquet(f"{folder}/parts").select("doc_id", "text", "lang", "source", "n_chars")
    halves = spark.read.parquet(f"{folder}/parquet")
    yield "union", halves.where("doc_id % 2 = 0").union(halves.where("doc_id % 2 = 1"))


def test_row_numbers_whatever_the_input(spark, tmp_path):
    from chronoscope.llm.dedup import unique_documents
    from chronoscope.llm.mixing import mixture
    from chronoscope.llm.near import without_near_duplicates

    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, t, "en", f"src{i % 3}", 1) for i, t in enumerate(["one two", "one  two", words, words + " more", "alone here", "", None])]
    for name, docs in inputs(spark, tmp_path, rows):
        numbered = shared.in_file_order(docs, "nth").collect()
        assert sorted(r.nth for r in numbered) == list(range(7)) and {r.doc_id for r in numbered} == set(range(7)), name
        assert sorted(r.doc_id for r in unique_documents(docs).collect()) == [1, 2, 3, 4, 5], name
        assert sorted(r.doc_id for r in without_near_duplicates(docs).collect()) == [0, 2, 4, 5, 6], name
        assert sorted(r.doc_id for r in mixture(docs, each=True).collect()) == list(range(7)), name


def test_only_whole_parquet_files_are_numbered_in_place(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/p")
    spark.range(10).write.orc(f"{tmp_path}/o")
    table = spark.read.parquet(f"{tmp_path}/p")
    assert shared.is_scan(table) and shared.is_scan(table.selectExpr("id + 1 as x")) and shared.is_scan(table.alias("t"))
    for other in (table.where("id > 3"), table.limit(3), table.union(table), table.selectExpr("rand() as x"), spark.read.orc(f"{tmp_path}/o"), table.distinct()):
        assert not shared.is_scan(other)


def test_shuffle_files_end_with_the_write(spark):
    """What a table's write shuffled is gone when it is written, and the session's setting is as before."""
    from chronoscope.llm import shared

    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(shared.CLEAN_UP, None)
    rows = shared.written(spark.range(20_000).selectExpr("id % 5000 AS k", "id AS v").groupBy("k").sum("v"), "sums")
    assert not shuffled() - before
    assert spark.conf.get(shared.CLEAN_UP, None) == setting
    assert rows.count() == 5000
