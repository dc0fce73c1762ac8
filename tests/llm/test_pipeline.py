import re
from collections import defaultdict

import corpus_pipeline
from tests.llm import odd, test_near, test_packing


def stages(spark, docs, sf_dir, folder):
    """What each stage gets and gives, written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return out


def check(found, columns):
    language, exact, near, mixing, packing = found
    for before, after in found[:-1]:
        assert after.columns == columns
    key = lambda df: sorted(map(str, df.collect()))
    before = language[0].collect()
    want = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert key(language[1]) == sorted(map(str, want))
    groups = defaultdict(list)
    for r in exact[0].collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append(r)
    kept = exact[1].collect()
    assert len(kept) == len(groups)
    for r in kept:
        own = groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)]
        assert (-len(r.text), r.doc_id is None, r.doc_id or 0) == min((-len(x.text), x.doc_id is None, x.doc_id or 0) for x in own)
    rows = [(r.doc_id, r.text) for r in near[0].collect()]
    parts = test_near.expected(rows, 5, 80)
    assert near[1].count() == len({c for *_, c in parts if c is not None}) + sum(c is None for *_, c in parts)
    assert {r.doc_id for r in near[1].collect()} == {c for *_, c in parts}
    assert key(mixing[0]) == key(mixing[1])
    test_packing.check(packing[1].collect(), [(r.doc_id, r.text) for r in packing[0].collect()], 2048)


def test_stages_on_a_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = stages(spark, docs, small, tmp_path)
    check(found, docs.columns)
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(str, whole.collect())) == sorted(map(str, found[-1][1].select(whole.columns).collect()))


def test_stages_on_odd_documents(spark, tmp_path):
    docs = odd.table(spark, tmp_path).withColumnRenamed("x", "lang_pred").withColumnRenamed("slot", "held_out")
    check(stages(spark, docs, str(tmp_path), tmp_path), docs.columns)


def test_stages_on_an_empty_table(spark, tmp_path):
    for _, after in stages(spark, odd.empty(spark, tmp_path), str(tmp_path), tmp_path):
        assert after.count() == 0




def source_shares(spark, packed, docs, share):
    """The sources' shares of the tokens in the first part of the sequences."""
    rows = packed.join(docs.select("doc_id", "source"), "doc_id").collect()
    ids = sorted({r.sequence_id for r in rows})
    first = set(ids[: int(len(ids) * share)])
    had = defaultdict(int)
    for r in rows:
        if r.sequence_id in first:
            had[r.source] += r.length
    return {s: n / sum(had.values()) for s, n in had.items()}


def test_the_weights_decide_what_run_packs_first(spark, tmp_path, monkeypatch):
    from chronoscope.llm import mixing, packing

    rows = [(i, f"words of document {i} " * 8, "en", f"src{i % 2}") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] in ("mixing", "packing")])
    monkeypatch.setattr(mixing.placed, "__defaults__", tuple(400 if x == 16_384 else x for x in mixing.placed.__defaults__))
    found = {}
    for group in (4096, 100):  # one range and several
        monkeypatch.setattr(packing.pack, "__defaults__", tuple(group if x == packing.GROUP_DOCUMENTS else x for x in packing.pack.__defaults__))
        for weights in ((9, 1), (1, 9)):
            monkeypatch.setattr(mixing, "WEIGHTS", {"src0": weights[0], "src1": weights[1], mixing.REST: 1})
            packed = corpus_pipeline.run(spark, str(tmp_path))
            test_packing.check(packed.collect(), [r[:2] for r in rows], 2048)
            found[group, weights] = source_shares(spark, packed, docs, 0.4)
    for group in (4096, 100):
        assert found[group, (9, 1)]["src0"] > 0.6 > 0.4 > found[group, (1, 9)]["src0"]


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    from chronoscope.llm.shared import in_file_order

    rows = [(i, "x" * (i % 97) * (1 + i // 2000 * 9)) for i in range(5000)]  # files of different sizes
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/o")
    assert all(r.doc_id == r.at for r in in_file_order(spark.read.parquet(f"{tmp_path}/o"), "at").collect())
