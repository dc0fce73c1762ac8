import math
import re
import unicodedata
import zlib

import pytest

from chronoscope.llm import quality
from tests.llm import odd

FOREST = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= -2.0E-4)
     Predict: 0.0
    Else (feature 1 > -2.0E-4)
     Predict: 1.0
"""


def test_rules_of_a_forest():
    assert quality.rules_of(FOREST) == [((0, "<=", 0.5),), ((0, "<=", 0.25),), ((0, "<=", 0.5), (0, ">", 0.25)), ((0, ">", 0.5),), ((1, "<=", -0.0002),), ((1, ">", -0.0002),)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark, medium):
    from chronoscope.llm.registry import op4_quality_classifier

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = op4_quality_classifier(spark, medium).collect()
    assert len(rows) == spark.read.parquet(f"{medium}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.95 * len(out)


def test_held_out_labels_are_not_looked_at(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def plain_statistics(text):
    """The statistics of a text in Python, one by one and without regular expressions where a loop says it as well."""
    text = text or ""

    def many(test):
        return sum(map(test, text))

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, parts = text.split("\n"), re.split(r"[\x20\x09-\x0D]+", text)
    chars, n = max(1, len(text)), max(1, len(words))
    return {
        "log_chars": math.log(1 + len(text)),
        "word_length": chars / n,
        "symbols": many(lambda c: c in "#$%&*<>{}=_~^\\/@+") / chars,
        "exclamations": many(lambda c: c in "!?") / n,
        "bars": text.count("|") / n,
        "capitals": many(lambda c: unicodedata.category(c) == "Lu") / chars,
        "digits": many(lambda c: c in "0123456789") / chars,
        "stops": many(lambda c: c in ".,;:") / n,
        "words_a_line": n / len(lines),
        "distinct_words": len(set(parts)) / len(parts),
        "distinct_lines": len(set(lines)) / len(lines),
        "same_word_again": sum(a == b for a, b in zip(words, words[1:])) / n,
    }


def plain_score(model, x):
    """The ensemble's probability, each rule evaluated by itself."""
    fires = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    total = model.intercept + sum(weight for rule, weight in model.rules if all(fires[sign](x[i], bound) for i, sign, bound in rule))
    return 1 / (1 + math.exp(-total))


def all_equal(spark, docs, labels, monkeypatch):
    """Compares every statistic and score with the plain ones; returns the model."""
    learned, learn = [], quality.learn
    monkeypatch.setattr(quality, "learn", lambda training: learned.append(learn(training)) or learned[-1])
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    plain = {t: plain_statistics(t) for _, t in texts}
    names = list(quality.statistics(quality.F.col("text")))
    assert all(list(x) == names for x in plain.values())
    for r in quality.with_statistics(docs).select("text", "x").collect():
        assert dict(zip(names, r.x)) == pytest.approx(plain[r.text], rel=1e-12)
    rows = quality.quality_scores(docs, labels).collect()
    (model,) = learned
    want = [(str(i), held(i), plain_score(model, list(plain[t].values()))) for i, t in texts]
    got = [(str(r.doc_id), r.held_out, r.score) for r in rows]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], rel=1e-9)
    return model


def test_statistics_and_scores_equal_plain_ones(spark, small, monkeypatch):
    model = all_equal(spark, spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"), monkeypatch)
    assert model.rules


def test_statistics_and_scores_of_odd_documents(spark, tmp_path, monkeypatch):
    texts = ["Ab Ab ab  ab\tab! é É \U0001d400 | |\n\n x  x", " lead", "trail ", "\n", "a\x85a a\u00a0a", "one\x0b\x0cone", "$&^_~\\/@+ %% 12.5;:"]
    docs = odd.table(spark, tmp_path).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    labels = docs.selectExpr("doc_id", "cast(length(coalesce(text, '')) > 30 as int) as quality").where("doc_id is not null")
    all_equal(spark, docs, labels.union(labels).union(labels), monkeypatch)


def test_very_long_texts_and_clashing_columns(spark):
    """Texts of megabytes count as a whole, and columns named as the operator's own aren't its own."""
    docs = spark.range(60).selectExpr("id as doc_id", "repeat(if(id % 2 = 0, 'Calm words stand here. ', '!! $$ || !! '), if(id < 2, 200000, 3)) as text", "0.5D as x", "true as held_out", "7 as y", "'s' as score", "1 as predicted")
    rows = {r.doc_id: r for r in quality.quality_scores(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality")).collect()}
    assert len(rows) == 60 and all(r.predicted == 1 - i % 2 for i, r in rows.items())


def test_odd_documents(spark, tmp_path):
    docs = odd.table(spark, tmp_path)
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(odd.rows())] + [(999, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert sorted((str(r.doc_id) for r in rows)) == sorted(str(r[0]) for r in odd.rows())
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)


def test_without_labels(spark, tmp_path):
    docs = odd.table(spark, tmp_path)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, quality int")
    assert len({r.score for r in quality.quality_scores(docs, ones).collect()}) == 1
    assert quality.quality_scores(odd.empty(spark, tmp_path), ones).collect() == []
