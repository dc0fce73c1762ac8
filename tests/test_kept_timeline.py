"""The kept timeline against a sorted list."""

import pytest

from chronoscope.operators import timeline
from chronoscope.operators.kept_timeline import KeptTimeline

ROWS = [(i * 37 % 1000, i, f"C:\\Users\\u{i % 50}\\{'ERROR' if i % 7 == 0 else 'file'}{i}.txt" if i % 11 else None) for i in range(1000)] + [(5, 2000, "ÉTÉ"), (5, 2001, "ab"), (None, 2002, "last? no: first")]
ORDERED = sorted(ROWS, key=lambda r: (r[0] is not None, r[0], r[1]))


@pytest.fixture(scope="module")
def kept(spark):
    df = spark.createDataFrame(ROWS, "us long, i long, path string").repartition(5)
    found = KeptTimeline(df, "us", "i", rows_a_part=64)
    yield found
    assert found.remove() and not found.remove()


def test_numbers_and_pages(kept):
    assert kept.count() == len(ROWS)
    assert [tuple(r) for r in kept.numbered().orderBy("idx").collect()] == [(*r, n) for n, r in enumerate(ORDERED)]
    for offset, limit in ((0, 10), (500, 130), (995, 100), (2000, 5), (0, 0)):
        found = kept.page(offset, limit).orderBy("idx").collect()
        assert [tuple(r)[:3] for r in found] == ORDERED[offset : offset + limit] and [r.idx for r in found] == list(range(offset, min(len(ROWS), offset + limit)))[: max(0, limit)]


def test_searches(kept):
    for query in ("error", "U7\\", "file14", "été", "ab", "nothing like it", "", "u1\\error7", "a"):
        want = [(n, r[2]) for n, r in enumerate(ORDERED) if query and r[2] is not None and query.lower() in r[2].lower()]
        assert [(r.idx, r.path) for r in kept.search(query).orderBy("idx").collect()] == want, query
        for start in (0, 400, 1002):
            after = [k for k, (n, _) in enumerate(want) if n >= start]
            assert tuple(kept.cursor(query, start).first()) == (after[0] if after else 0, len(want))


def test_reads_are_bounded(kept):
    """A page and a search read the files of their parts and no others."""
    every = kept.manifest.count()
    assert every > 10 and 1 <= len(kept.page_parts(500, 10)) <= 2 and kept.page_parts(5000, 10) == []
    few = kept.search_parts("file995")
    assert 1 <= len(few) < every / 2 and kept.search_parts("no such text") == []
    plan = kept.page(500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "kept_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Sort" not in plan and "Exchange rangepartitioning" not in plan


def test_empty_and_no_trigram(spark):
    none = KeptTimeline(spark.createDataFrame([], "us long, path string"), "us")
    assert none.count() == 0 and none.page(0, 5).count() == 0 and none.search("abc").count() == 0 and none.cursor("abc", 3).first() == (0, 0)
    none.remove()


def test_histogram(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None)], "day int, kind string")
    found = sorted(map(tuple, timeline.histogram(rows, [("day",), ("kind",), ()]).collect()), key=str)
    assert found == sorted([(1, None, 2, 1), (2, None, 2, 1), (None, "a", 2, 2), (None, "b", 1, 2), (None, None, 1, 2), (None, None, 4, 3)], key=str)
