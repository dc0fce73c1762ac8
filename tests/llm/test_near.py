import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoscope.llm import components, near
from tests.llm import odd


def expected(rows, width, percent):
    """{(id, text): (set size, smallest reachable id)} by comparing all pairs."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def linked_texts(rows, width, percent):
    """{(text, text)} of different shingle sets that are similar, by comparing all pairs."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        if w:
            sets.setdefault(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]), t)
    found = list(sets)
    return {frozenset((a, b)) for i, a in enumerate(found) for b in found[:i] if a & b and 100 * len(a & b) >= percent * len(a | b)}, found


def run(docs, width, percent):
    found = near.near_duplicates(docs, width=width, percent=percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_odd_documents(spark, tmp_path, width, percent):
    docs = odd.table(spark, tmp_path)
    rows = [r[:2] for r in odd.rows()]
    assert run(docs, width, percent) == expected(rows, width, percent)
    if width == 5:
        left = near.without_near_duplicates(docs)
        want = expected(rows, width, percent)
        assert left.columns == docs.columns
        assert left.count() == len({c for *_, c in want if c is not None}) + sum(c is None for *_, c in want)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 50)])
def test_variants_of_one_text(spark, tmp_path, width, percent, monkeypatch):
    """Many variants, so that lists of common shingles are long; passages that many share; chains of small changes."""
    monkeypatch.setattr(near, "COMMON", 4)
    rng = random.Random(width)
    base = [f"b{rng.randrange(60)}" for _ in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    passage = base[:25]
    rows += [(200 + i, " ".join([f"o{rng.randrange(300)}" for _ in range(rng.randrange(3, 30))] + passage)) for i in range(60)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):
        chain[i] = f"d{i}"
        rows.append((300 + i, " ".join(chain)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/v.parquet")
    assert run(spark.read.parquet(f"{tmp_path}/v.parquet"), width, percent) == expected(rows, width, percent)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 200), st.integers(0, 200), st.sampled_from([50, 80, 90]), st.integers(0, 99))
def test_sketches_lose_no_link(common, own, other, percent, seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 1 << 63, common + own + other, dtype=np.uint64)
    a, b = tokens[: common + own], np.concatenate([tokens[:common], tokens[common + own :]])
    x, y = near.parity_sketch(a), near.parity_sketch(b)
    if len(x) < len(y):
        x, y = y, x
    if 100 * common >= percent * len(tokens):
        assert len(x) <= 2 * len(y)
        if len(x) > len(y):
            x = x[: len(y)] ^ x[len(y) :]
        n, m = len(a), len(b)
        needed = (percent * (n + m) + 99 + percent) // (100 + percent)
        assert sum(int(v).bit_count() if v >= 0 else int(v + (1 << 64)).bit_count() for v in (x ^ y).tolist()) <= n + m - 2 * needed


def texts_of_passages(rng, many, passages, length):
    """Texts made of common passages alone: they share most of their shingles with others but are similar to few."""
    stock = [" ".join(f"p{k}x{rng.randrange(10_000)}" for _ in range(length)) for k in range(passages)]
    return [" ".join(rng.sample(stock, 6)) for _ in range(many)]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (3, 50)])
def test_texts_of_common_passages(spark, tmp_path, width, percent, monkeypatch):
    """Lists of common shingles alone, groups of one prefix with different members, and all links."""
    monkeypatch.setattr(near, "COMMON", 4)
    rng = random.Random(percent)
    rows = list(enumerate(texts_of_passages(rng, 90, 14, 12)))
    shared = [f"s{i}" for i in range(12)]  # short texts that share their first shingles in the order, whichever these are
    rows += [(500 + i, " ".join(shared[: 9 + i % 3] + [f"t{i % 7}"] * (1 + i % 2))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/p.parquet")
    docs = spark.read.parquet(f"{tmp_path}/p.parquet")
    assert run(docs, width, percent) == expected(rows, width, percent)
    links, members = near.similar_classes(docs, width=width, percent=percent)
    want, classes = linked_texts(rows, width, percent)
    found = [(r.a, r.b) for r in links.collect()]
    assert len(set(found)) == len(found) == len(want) and all(a < b for a, b in found)
    of = {r.doc_id: r.cls for r in members.collect()}
    assert len(set(of.values())) == len(classes)
    text = {}
    for i, t in rows:
        text.setdefault(of[i], t)
    lower = lambda t: frozenset(tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1))
    assert {frozenset((lower(text[a]), lower(text[b]))) for a, b in found} == want


def test_members_of_one_group_that_differ(spark, tmp_path):
    """Sets of one size and prefix meet by what follows the prefix, and no link among them is lost."""
    import pyarrow as pa

    from chronoscope.llm.shingles import shingle_sets

    rng = random.Random(2)
    words = sorted((f"w{i}" for i in range(20)), key=lambda w: int(shingle_sets(pa.array([w]), 1)[0][0]))
    rows = [(i, " ".join(words[:3] + rng.sample(words[3:], 9))) for i in range(80)]  # 12 words, of which the first 3 are the prefix
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/g.parquet")
    docs = spark.read.parquet(f"{tmp_path}/g.parquet")
    assert run(docs, 1, 80) == expected(rows, 1, 80)
    found = near.PrefixLists(docs, "doc_id", "text", 1, 80, None)
    members = near.written(found.in_group.selectExpr("gid", "cls", "cls as comp"), "m")
    assert members.select("gid").distinct().count() == 1
    pairs = near.pairs_within(members, found.rows, found.classes, 1, 80, found.common).count()
    links, _ = near.similar_classes(docs, width=1, percent=80)
    many = members.count()
    assert links.count() == len(linked_texts(rows, 1, 80)[0]) <= pairs < many * (many - 1) // 2


def test_clashing_names_and_other_inputs(spark, tmp_path):
    docs = odd.table(spark, tmp_path).selectExpr("doc_id", "text", "doc_id as near_row", "'c' as component_id", "1 as cls", "2 as t")
    want = near.without_near_duplicates(docs)
    assert want.columns == docs.columns and all(r.near_row == r.doc_id and r.component_id == "c" for r in want.collect())
    for df in (docs.repartition(4), docs.union(docs.limit(0))):
        left = near.without_near_duplicates(df)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in want.collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(350)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = {r.v: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: root(v) for v in found} and all(v in found for a, b in edges if a != b for v in (a, b))


@pytest.mark.parametrize("order", ["random", "ascending", "descending", "zigzag"])
def test_rounds_of_components(spark, monkeypatch, order):
    """A chain of 2,000 vertices, whatever its labels: about 3 log2 n tables at most."""
    n = 2000
    labels = list(range(n))
    if order == "random":
        random.Random(4).shuffle(labels)
    elif order == "descending":
        labels.reverse()
    elif order == "zigzag":
        labels = [x for pair in zip(range(n // 2), range(n // 2, n)) for x in pair]
    made, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: made.append(name) or real(df, name))
    found = components.components(spark.createDataFrame(list(zip(labels, labels[1:])), "a long, b long"))
    assert found.where("comp = 0").count() == n == found.count()
    assert len(made) <= 35, made


def test_empty_table(spark, tmp_path):
    assert near.near_duplicates(odd.empty(spark, tmp_path)).collect() == []
    assert near.without_near_duplicates(odd.empty(spark, tmp_path)).collect() == []
