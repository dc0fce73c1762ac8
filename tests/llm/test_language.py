import zlib

import numpy as np
import pyarrow as pa

from chronoscope.llm import language
from tests.llm import odd


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_trigrams():
    def packed(a, b, c):
        return ord(a) << 42 | ord(b) << 21 | (ord(c) if c else 0) if a else ord(b) << 21 | (ord(c) if c else 0)

    grams, text = language.trigrams(pa.array(["Ab, c", "", "1 2", "É"]))
    assert grams.tolist() == [packed("", "a", "b"), packed("a", "b", ""), packed("", "c", ""), packed("", "é", "")]
    assert text.tolist() == [0, 0, 0, 3]


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    words = np.zeros((2, language.SLOTS), np.uint64)
    words[0] |= np.where(rng.random(language.SLOTS) < 0.5, np.uint64(1), np.uint64(0))
    words[1] |= np.where(rng.random(language.SLOTS) < 0.9, np.uint64(1) << np.uint64(3), np.uint64(0))
    model = language.LanguageFilter([f"l{i}" for i in range(68)], words)
    text = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 20000, 5000))
    share, many = model.shares(pa.array([text]))
    assert many[0] == 5000 and share[0, 0] < 0.05 and share[0, 67] < 0.1 and share[0, 1] == 0


def test_held_out_accuracy(spark, medium):
    from chronoscope.llm.registry import op8_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = op8_language_id(spark, medium).collect()
    assert len(rows) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.98 * len(out)


def test_labels_of_held_out_documents_change_nothing(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("held", language.held_out("doc_id", 4, 2)).selectExpr("doc_id", "text", "if(held, 'xx', lang) as lang")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identified_documents(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.identified_documents(other).collect()}


def test_odd_documents(spark, tmp_path):
    docs = odd.table(spark, tmp_path)
    rows = language.identified_documents(docs.select("doc_id", "text", "lang", "score")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred in (("en", "fr") if has_letter else ("und",)) and r.held_out == held(r.doc_id)
        assert 0 <= r.score <= 1 and (has_letter or r.score == 0)


def test_nothing_to_learn(spark, tmp_path):
    docs = odd.table(spark, tmp_path).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language.identified_documents(docs).collect()} == {("und", 0.0)}
    assert language.identified_documents(odd.empty(spark, tmp_path)).collect() == []


def test_more_than_64_languages(spark):
    rows = [(i, chr(0x4E00 + i * 3) * 5 + chr(0x4E01 + i * 3), f"l{i:03}") for i in range(150)]
    model = language.learn(spark.createDataFrame(rows, "i long, t string, lang string").select("lang", "t"))
    found = language.identify(spark.createDataFrame(rows, "i long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang for r in found)


def plain_trigrams(text):
    """Trigrams of a text one by one: every letter with what stands beside it, anything but a letter as a blank."""
    t = (text or "").lower()
    blank = lambda i: t[i] if 0 <= i < len(t) and t[i].isalpha() else " "
    return [blank(i - 1) + t[i] + blank(i + 1) for i in range(len(t)) if t[i].isalpha()]


def test_scores_equal_those_of_exact_sets(spark, medium):
    """Against plain sets of trigrams for each language and level: the filter's false positives are corrected to within a hundredth."""
    from collections import Counter

    from chronoscope.llm.registry import op8_language_id

    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(plain_trigrams(r.text))
    sets = {(lang, share): {g for g, n in c.items() if n >= share * sum(c.values())} for lang, c in counts.items() for share in language.LEVELS}
    found = {r.doc_id: r for r in op8_language_id(spark, medium).collect()}
    off = 0
    for r in docs:
        grams = plain_trigrams(r.text)
        if not grams:
            assert found[r.doc_id].lang_pred == "und"
            continue
        share = {lang: sum(sum(g in sets[lang, s] for g in grams) for s in language.LEVELS) / len(grams) / len(language.LEVELS) for lang in counts}
        assert abs(found[r.doc_id].score - max(share.values())) < 0.01
        off += found[r.doc_id].lang_pred != min(share, key=lambda x: (-share[x], x))
    assert off <= 0.005 * len(docs)


def test_every_trigram_is_in_the_filter(spark):
    rows = [("en", "the " * 200_000 + "qzx"), ("fr", "les " * 1000)]
    model = language.learn(spark.createDataFrame(rows, "lang string, t string"))
    grams, _ = language.trigrams(pa.array(["qzx"]))
    assert model.levels == len(language.LEVELS) and all(model.bit(0, model.contained(grams)))  # in level 0 of en
    assert not any(model.bit(4, model.contained(grams)))  # but not among the frequent ones


def test_a_very_large_number_of_languages_keeps_the_table_small(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 1 << 12)
    monkeypatch.setattr(language, "SLOTS", 1 << 14)
    rows = [(i, chr(0x4E00 + i * 3) * 5 + chr(0x4E01 + i * 3), f"l{i:03}") for i in range(150)]
    model = language.learn(spark.createDataFrame(rows, "i long, t string, lang string").select("lang", "t"))
    assert model.words.shape == (8, 1 << 10)
    found = language.identify(spark.createDataFrame(rows, "i long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 145


def test_repeated_empty_and_very_long_texts(spark):
    rows = [("en", "this is a text with words"), ("fr", "ceci est une phrase avec des mots")] * 20
    model = language.learn(spark.createDataFrame(rows, "lang string, t string"))
    texts = [(1, "ceci est " * 400_000), (1, "ceci est"), (1, "ceci est"), (2, ""), (3, None)]
    found = language.identify(spark.createDataFrame(texts, "i long, text string"), model).collect()
    assert [r.lang_pred for r in found] == ["fr", "fr", "fr", "und", "und"]
    assert language.identify(spark.createDataFrame([], "i long, text string"), model).collect() == []


def test_pieces_have_the_trigrams_of_the_whole(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 7)
    text = "Some words, andaverylongwordwithoutanend 12 été. a b  c"
    parts = language.pieces(text)
    assert "".join(parts) == text and len(parts) > 3
    assert sorted(g for p in parts for g in language.trigrams(pa.array([p]))[0].tolist()) == sorted(language.trigrams(pa.array([text]))[0].tolist())
    words = np.full((1, language.SLOTS), 3, np.uint64)
    model = language.LanguageFilter(["a", "b"], words)
    share, many = model.shares(pa.array([text]), np.zeros(2))
    assert many[0] == sum(c.isalpha() for c in text) and share.tolist() == [[0.5, 0.5]] or share.tolist() == [[1.0, 1.0]]
