import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronoscope.llm import brown
from tests.llm import odd


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def words(text):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + [None]


def expected(rows):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows]


def check(found, rows):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found]
    want = expected(rows)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def information(table, of):
    size = of.max() + 1
    hot = np.eye(size)[of]
    g = hot.T @ table @ hot
    return brown.entropy_terms(g).sum() - brown.entropy_terms(g.sum(0)).sum() - brown.entropy_terms(g.sum(1)).sum()


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(2)
    true = np.arange(40) % 4
    table = np.zeros((41, 41))
    state = 0
    for _ in range(20_000):  # classes follow each other in a circle
        after = rng.choice(np.flatnonzero(true == (true[state] + 1) % 4))
        table[state, after] += 1
        state = after
    of = brown.exchange(table, 5, 20)
    assert of[-1] == 0 and (of[:-1] > 0).all()
    start = np.concatenate([1 + np.arange(40) % 4, [0]])
    assert information(table, of) >= information(table, start) - 1e-6
    assert all(len(set(of[:-1][true == k])) == 1 for k in range(4))


def test_exchange_never_loses_information():
    rng = np.random.default_rng(4)
    table = rng.integers(0, 5, (60, 60)).astype(float)
    seen = [information(table, brown.exchange(table, 8, p)) for p in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))


def test_base_scores_and_gain_on_held_out(spark, medium, monkeypatch):
    from chronoscope.llm.registry import op10_lm_scoring

    monkeypatch.setattr(brown, "FREQUENT", 500)  # so that many words are looked up by the join
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    found = op10_lm_scoring(spark, medium).collect()
    check(found, [tuple(r) for r in docs])
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_and_scores_one_by_one(spark, tmp_path, monkeypatch):
    """Over all known words and one unknown word of each class, after any class; and every score from the classes, word by word."""
    from chronoscope.llm.shingles import string_hashes

    monkeypatch.setattr(brown, "OWN_UNITS", 20)
    monkeypatch.setattr(brown, "FREQUENT", 30)
    rows = [(i, " ".join(f"w{(i * j) % 37 + (i * j % 7) * 40}" for j in range(1, 30))) for i in range(60)] + [(60, None), (61, "a b a"), (62, "new w1 words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/b.parquet")
    docs = spark.read.parquet(f"{tmp_path}/b.parquet")
    sequences, classes, first, model = brown.trained(docs)
    assert np.allclose((10**model.steps).sum(1), 1)
    of = {r.word: (r.c, r.cls) for r in classes.collect()}
    mass = np.zeros(len(model.emission))
    for c, k in of.values():
        mass[k] += c + 0.5
    learning = [r for r in rows if not held(r[0])]
    mass[0] += len(learning) + 0.5
    assert np.allclose(mass + 0.5, 10**model.emission)
    hashed = lambda x: int(string_hashes(pa.array([x])).view(np.int64)[0])
    assert set(of) == {hashed(w) for _, t in learning for w in words(t)[:-1]}  # every word has a class of its own choice
    assert all(k > 0 for _, k in of.values())
    grams = np.zeros_like(model.steps)

    def tokens(t):
        out = []
        for w in words(t)[:-1]:
            if (h := hashed(w)) in of:
                out.append(of[h])
            else:
                out.append((0, int(first.endings[int(string_hashes(pa.array([w[-3:]]))[0] % brown.ENDING_UNITS)])))
        return [*out, (len(learning), 0)]

    for _, t in learning:
        before = 0
        for _, k in tokens(t):
            grams[before, k] += 1
            before = k
    share = (grams.sum(0) + 0.5) / (grams.sum() + 0.5 * len(grams))
    assert np.allclose(model.steps, np.log10((grams + brown.SMOOTHING * share) / (grams.sum(1, keepdims=True) + brown.SMOOTHING)))
    found = {r.doc_id: r.score for r in brown.brown_scores(docs).collect()}
    for i, t in rows:
        want, before = 0.0, 0
        for c, k in tokens(t):
            want += model.steps[before, k] + math.log10(c + 0.5) - model.emission[k]
            before = k
        assert found[i] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_words_choose_the_best_class():
    """Against the information of the whole table with the word in each class; staying is free, leaving has a price."""
    rng = np.random.default_rng(3)
    sides, ns, ends, home = [], [], [], []
    for _ in range(80):
        some = rng.choice(12, rng.integers(1, 9), replace=False)
        sides += sorted(some.tolist())
        ns += rng.integers(1, 30, len(some)).tolist()
        ends.append(len(sides))
        home.append(int(rng.integers(1, 6)))
    grams = rng.integers(1, 40, (6, 6)).astype(float) + 100 * np.eye(6) + 30
    got = brown.best_classes(np.array(sides), np.array(ns), np.array(ends), np.array(home), grams)

    def total(g):
        return brown.entropy_terms(g).sum() - brown.entropy_terms(g.sum(1)).sum()

    stayed = 0
    for i, end in enumerate(ends):
        start, value = ends[i - 1] if i else 0, []
        for k in range(1, 6):
            after, before = grams.copy(), grams.T.copy()  # rows: the word's class
            for side, n in zip(sides[start:end], ns[start:end]):
                table = after if side < 6 else before
                table[home[i], side % 6] -= n
                table[k, side % 6] += n
            value.append(total(after) + total(before))
        stay = value[home[i] - 1]
        if max(value) - stay > math.log(6):
            assert value[got[i] - 1] == pytest.approx(max(value))
        else:
            assert got[i] == home[i]
            stayed += 1
    assert 0 < stayed < 80


def test_odd_documents(spark, tmp_path):
    check(brown.brown_scores(odd.table(spark, tmp_path)).collect(), [r[:2] for r in odd.rows()])
    assert brown.brown_scores(odd.empty(spark, tmp_path)).collect() == []
    path = f"{tmp_path}/held.parquet"  # nothing to learn from
    rows = [(i, f"text {i}") for i in range(60) if held(i)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    check(brown.brown_scores(spark.read.parquet(path)).collect(), rows)
