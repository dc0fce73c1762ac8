import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoscope.llm import packing
from chronoscope.llm.encoder import WordEncoder
from chronoscope.llm.registry import tokenizer_path
from tests.llm import odd


def tokens(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = [t or "" for _, t, *_ in odd.rows()] + ["İstanbul ßa 12.5% a&&& ok， ʼn ﬁ á. ¹² Ⅷ x\u0085y ǅ", "we'll've 'S 's", "a.b,c;d!?"]
    for most in (32 << 20, 400):  # with a cache that is forgotten at once too
        coder = WordEncoder(tokenizer_path(), most_bytes=most, words_a_call=4)
        for _ in range(2):
            ids, bounds = coder.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == tokens(texts)


_coder = None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=40), max_size=6))
def test_encoder_on_any_text(texts):
    global _coder
    _coder = _coder or WordEncoder(tokenizer_path())
    ids, bounds = _coder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == tokens(texts)


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, room = packing.first_fit_decreasing(lengths, 50)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(free) if r >= lengths[i]), len(free))
        if b == len(free):
            free.append(50)
        free[b] -= lengths[i]
        want[i] = b
    assert bins == [want[i] for i in range(len(lengths))] and list(room) == free


def check(rows, texts, capacity):
    """rows: of pack, texts: (id, text); every id in exactly one piece."""
    ids = defaultdict(list)
    for (i, _), found in zip(texts, tokens([t or "" for _, t in texts])):
        ids[i].append(found + [1])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in ids.items():
        want = sorted((s, len(d[s : s + capacity]), zlib.crc32(np.array(d[s : s + capacity], "<u4").tobytes()), len(d)) for d in own for s in range(0, len(d), capacity))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i]) == want
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


def test_odd_documents(spark, tmp_path):
    docs = odd.table(spark, tmp_path)
    for capacity, group in ((2048, 4096), (64, 5)):
        check(packing.pack(docs, tokenizer_path(), capacity=capacity, group_documents=group).collect(), [r[:2] for r in odd.rows()], capacity)


def test_empty_table(spark, tmp_path):
    assert packing.pack(odd.empty(spark, tmp_path), tokenizer_path()).collect() == []


def test_query_and_padding(spark, medium):
    from chronoscope.llm.registry import op1_packing

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = op1_packing(spark, medium).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    used = len({r.sequence_id for r in rows}) * 2048
    assert sum(r.length for r in rows) > 0.98 * used


def test_sequences_hold_the_ids(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(60)))) for i in range(40)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), capacity=100, with_ids=True)
    found = packing.sequences(packed, 100, pad_id=0).collect()
    assert all(len(r.ids) == 100 and set(r.ids[r.n_ids :]) <= {0} for r in found)
    assert sorted(x for r in found for x in r.ids[: r.n_ids]) == sorted(x for d in tokens([t for _, t in rows]) for x in [*d, 1])
