import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoscope.llm import tokenfiles
from chronoscope.llm.eliasfano import EliasFano, encode
from chronoscope.llm.registry import tokenizer_path
from tests.llm import odd
from tests.llm.test_packing import tokens


@given(st.lists(st.integers(0, 1 << 45), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_elias_fano(values, a, b):
    values = sorted(values)
    coded = EliasFano(encode(np.array(values, np.uint64)))
    assert len(coded) == len(values)
    a, b = sorted((min(a, len(values)), min(b, len(values))))
    assert coded.range(a, b).tolist() == values[a:b]
    assert all(coded.select(i) == values[i] for i in range(0, len(values), 7))


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700))
    assert len(encode(values)) * 8 / len(values) < 2 + np.log2(700) + 1
    with pytest.raises(IndexError):
        EliasFano(encode(values)).range(0, 10_001)


def expected(rows):
    found, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (i, _), ids in zip(order, tokens([t or "" for _, t in order])):
        ids = ids + [1]
        found.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_odd_documents(spark, tmp_path):
    rows = tokenfiles.round_trip(odd.table(spark, tmp_path), tokenizer_path(), f"file://{tmp_path}/files").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected([r[:2] for r in odd.rows()])
    manifest = tokenfiles.shards(spark, f"file://{tmp_path}/files").orderBy("shard").collect()
    for row in manifest:  # single documents by select
        reader = tokenfiles.ShardReader(f"file://{tmp_path}/files", row.path)
        assert sum(len(reader.document(i)) for i in range(reader.docs)) == reader.n_ids == row.n_ids
        reader.close()


def test_damaged_file(tmp_path, spark):
    tokenfiles.round_trip(odd.table(spark, tmp_path), tokenizer_path(), f"file://{tmp_path}/files").count()
    path = next((tmp_path / "files").glob("*.tok"))
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(ValueError, match="not a whole"):
        tokenfiles.ShardReader(f"file://{tmp_path}/files", path.name)


def test_empty_table(spark, tmp_path):
    assert tokenfiles.round_trip(odd.empty(spark, tmp_path), tokenizer_path()).collect() == []


def test_query(spark, small):
    from chronoscope.llm.registry import op5_token_files

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op5_token_files(spark, small).collect())) == expected([tuple(r) for r in docs])
