"""The filter audit against a plain walk through every order, and its DuckDB twin."""

import itertools
import re
from collections import Counter

import duckdb
import pytest

from chronoscope.llm import audit
from tests.llm.odd import empty, rows, table

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """docs: (doc_id, text, source). Every order is applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": t in least and (i is None or i > least[t]),
        }
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, found in parts.items():
        steps, removals = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for k, letter in enumerate(order):
                gone, left = [x for x in left if x[0][letter]], [x for x in left if not x[0][letter]]
                removals[letter] += len(gone)
                failing = sum(x[0][letter] for x in found)
                alone = sum(x[0][letter] and sum(x[0].values()) == 1 for x in found)
                steps.append((letter, [part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]))
        out += [(*row, removals[letter]) for letter, row in steps]
    return sorted(out)


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_odd_rows(spark, tmp_path):
    """Nulls in ids, texts, sources and labels; repeated ids and rows; long texts; clashing names."""
    labels = [(1, 1, 1), (5, 1, 0), (6, 0, 1), (6, 1, None), (20, 1, 1), (None, 1, 1), (4, None, None), (99, 1, 1)]
    extra = [(100 + i, "Aa Bb #" if i % 3 else None, "src0") for i in range(30)] + [(i, "same", None) for i in (7, 7, 300)]
    docs = table(spark, tmp_path).select("doc_id", "text", "source", "lang", "x").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"), allowMissingColumns=True)
    want = plain([(r[0], r[1], r[3]) for r in rows()] + extra, labels)
    assert result(audit.filter_audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", audit.F.lit("x")))) == want


def test_texts_without_ids(spark):
    docs = [(None, "a b", "s"), (None, "a b", "s"), (None, "c", "s"), (4, "c", "t")]
    assert result(audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS))) == plain(docs, [])


def test_empty_table(spark, tmp_path):
    assert audit.filter_audit(empty(spark, tmp_path), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("folder", ["small", "medium"])
def test_documents_and_twin(spark, request, folder):
    path = request.getfixturevalue(folder)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    found = result(audit.filter_audit(docs, labels))
    assert found == plain([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    base = duckdb.connect()
    for name in ("documents", "labels"):
        base.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    assert sorted(base.execute(f"select {', '.join(COLUMNS)} from ({audit.ORACLE_SQL})").fetchall()) == found


def test_a_set_is_visited_once(spark, monkeypatch):
    """Other filters than the five, and each set of them counted once."""
    data = spark.createDataFrame([("p", f, f % 2 == 0, False, f + 1) for f in range(8)], "part string, fails int, good boolean, toxic boolean, documents long")
    edges = audit.trie_edges(data, "XYZ").collect()
    assert sorted((r.applied, r.filter) for r in edges) == sorted((s, x) for s in range(7) for i, x in enumerate("XYZ") if not s >> i & 1)
    assert {(r.applied, r.filter): r.removed for r in edges}[0b011, "Z"] == 5
    assert audit.audit(data, "XYZ").where("filter_order = 'ZXY' and step = 3").select("kept", "removed", "redundant").collect()[0] == (1, 3, 3 + 4 + 7 + 8 - 3)
