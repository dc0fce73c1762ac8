import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from chronoscope.llm import dedup
from tests.llm import odd


def expected(rows):
    """(id, keep id, group size, digest) counts, and how many rows of a group stay (always one)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, found in groups.items():
        keep = min(found)[3]
        out += [(i, keep, len(found), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in found]
    return sorted(out, key=str), len(groups)


def check(result, rows):
    want, groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in result), key=str) == want
    kept = [r for r in result if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_odd_documents(spark, tmp_path):
    docs = odd.table(spark, tmp_path)
    check(dedup.exact_duplicates(docs).collect(), [r[:2] for r in odd.rows()])
    left = dedup.unique_documents(docs)
    assert left.columns == docs.columns and left.count() == expected([r[:2] for r in odd.rows()])[1]


def test_hashes_of_several_chunks_are_told_apart(spark, tmp_path, monkeypatch):
    """With lengths for hashes most chunks share theirs; only these go beside the recipes, and groups are right all the same."""
    rng = random.Random(4)
    docs = odd.table(spark, tmp_path)
    assert dedup.shared_hashes(docs, "text") == []
    long = ["".join(rng.choice("abcdefgh") for _ in range(9000)) for _ in range(3)]
    rows = [r[:2] for r in odd.rows()] + [(100 + i, t) for i, t in enumerate(long + long[:1])] + [(200, long[0] + "!"), (201, "a unique length of a text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/c.parquet")
    monkeypatch.setattr(dedup, "identifier", F.length)
    docs = spark.read.parquet(f"{tmp_path}/c.parquet")
    several = set(dedup.shared_hashes(docs, "text"))
    found = {r.doc_id: r for r in dedup.recipes(docs).collect()}
    assert several and all(len(x) in several for r in found.values() for x in r.doubtful) and len(found[4].recipe) > 1
    assert all(len(r.doubtful) == sum(x in several for x in r.recipe) for r in found.values())
    check(dedup.exact_duplicates(docs).collect(), rows)


def test_chunks_follow_content_in_any_script(spark):
    rng = random.Random(9)
    for low, many in ((0x430, 32), (0x4E00, 300), (0x5D0, 27)):
        text = "".join(chr(low + rng.randrange(many)) for _ in range(60_000))
        rows = spark.createDataFrame([(0, text), (1, text[:10] + "\u00b7" + text[10:])], "i int, t string").select("i", dedup.chunks(dedup.normalised(F.col("t"))).alias("c")).orderBy("i").collect()
        assert len(set(rows[0].c) & set(rows[1].c)) >= len(rows[0].c) // 2


def test_clashing_names_and_other_inputs(spark, tmp_path):
    """Columns named as the operator's own stay, and what is no scan of files works too."""
    docs = odd.table(spark, tmp_path).selectExpr("doc_id", "text", "doc_id as dedup_row", "'x' as recipe", "'y' as `a.b`", "1 as order_file")
    want = expected([r[:2] for r in odd.rows()])[1]
    for df in (docs, docs.union(docs.limit(0)), docs.repartition(5), docs.join(docs.select(F.lit(1).alias("one")).limit(1))):
        left = dedup.unique_documents(df)
        assert left.columns == df.columns and left.count() == want
        assert all(r.dedup_row == r.doc_id and r.recipe == "x" and r["a.b"] == "y" for r in left.collect())


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    rows = spark.createDataFrame([(0, text), (1, "zz" + text)], "i int, t string").select("i", dedup.chunks(dedup.normalised(F.col("t"))).alias("c")).orderBy("i").collect()
    a, b = rows[0].c, rows[1].c
    assert "".join(a) == text and "".join(b) == "zz" + text and all(len(x) <= dedup.MOST + 4 for x in a)
    assert len(set(a) & set(b)) >= len(a) // 2  # most chunks are the same again after an insertion


def test_a_hot_group(spark, tmp_path):
    rows = [(i, "same text here" + " " * (i % 5)) for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 6000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/hot.parquet")
    check(dedup.exact_duplicates(spark.read.parquet(f"{tmp_path}/hot.parquet")).collect(), rows)


def test_empty_table(spark, tmp_path):
    assert dedup.exact_duplicates(odd.empty(spark, tmp_path)).collect() == []
    assert dedup.unique_documents(odd.empty(spark, tmp_path)).collect() == []


def test_plan_has_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
