"""Byte-level BPE through a sentencepiece model against tiktoken."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from chronoscope.llm import bytebpe
from chronoscope.llm.chunks import CHUNK, ChunkTable, windows
from tests.llm.odd import empty, rows, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def codec():
    return bytebpe.ByteCodec(RANKS, PATTERN)


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_random_texts(codec, plain):
    rng = random.Random(3)
    for signs in ("ab1 \n\t\r'st! 　\xa0́é漢\U0001f600\x1c\x85<|>▁", "".join(map(chr, range(128))) + "  ''''stremlvd" * 3, "éßñ 中文字 अआ ٣4"):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 120))) for _ in range(2000)]
        assert [ids(x) for x in codec.encode(texts)] == [plain(t) for t in texts]
        assert [codec.decode(x).decode() for x in codec.encode(texts)] == texts


def test_every_code_point(codec, plain):
    """Letters, numbers and white space mean the same to both, so texts are cut alike."""
    texts = [f"a{c}b {c}1{c} \n{c}{c} x" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not 0x4E10 < ord(c) < 0x9F00 and not 0xAC10 < ord(c) < 0xD700 and ord(c) < 0x32000]
    assert [ids(x) for x in codec.encode(texts)] == [plain(t) for t in texts]


def test_very_long_texts(codec, plain):
    rng = random.Random(4)
    for text in ("".join(rng.choices("abcdefgh", k=150_000)), "".join(rng.choices("ab \n'", k=2_500_000)), " " * 100_000 + "x", "9" * 100_000):
        assert ids(codec.encode([text])[0]) == plain(text)


def test_windows_are_cut_where_no_token_crosses(codec, plain):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("ab1 \n\t\r'st!　\x85é", k=rng.randint(0, 200)))
        parts = list(windows(text, 7))
        assert "".join(parts) == text == "".join(CHUNK.findall(text))
        assert [i for part in parts for i in plain(part)] == plain(text)
        assert b"".join(b"".join(v) for _, v in codec.table.of_texts([text, ""], 7)) == codec.encode([text])[0]


def test_every_token_is_itself(codec):
    for i, token in list(enumerate(codec.tokens))[:: 7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if codec.table.cut(text) == [text]:
            assert ids(codec.encode([text])[0]) == [i]


def test_tokens_that_merges_do_not_reach():
    """A match that is a token is that token, as the library has it, even where merging by rank ends elsewhere."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258}  # from abc, bc is merged first: no a + bc, but abc is a token
    ranks |= {b"abcd": 259}
    import tempfile, base64  # noqa: E401

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as file:
        file.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        file.flush()
        codec = bytebpe.ByteCodec(file.name, PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for text in ("abcd", "abc", "ab", "xabcd", "abcdabcd", "dabc abcd"):
        assert ids(codec.encode([text])[0]) == theirs(text), text


def test_model_needs_whole_ranks():
    with pytest.raises(ValueError, match="ranks"):
        bytebpe.serialized_model({b"a": 1})
    with pytest.raises(ValueError, match="byte"):
        bytebpe.serialized_model({b"a": 0})


def test_table_forgets(codec):
    calls = []
    small = ChunkTable(str.split, lambda new: calls.append(len(new)) or [b"v"] * len(new), most_bytes=300)
    for text in ("a b", "a b", "c d", "a b"):
        assert [v for _, v in small.of_texts([text])] == [[b"v", b"v"]]
    assert calls == [2, 2, 2]


def digest_rows(found, plain):
    out = []
    for i, text in found:
        raw = struct.pack(f"<{len(want := plain(text or ''))}I", *want)
        out.append((i, len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark, tmp_path, plain):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    found = bytebpe.digests(bytebpe.encoded(table(spark, tmp_path), RANKS, PATTERN, decode=True))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == digest_rows([r[:2] for r in rows()], plain)


def test_documents(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = bytebpe.digests(bytebpe.encoded(docs, RANKS, PATTERN, decode=True))
    assert sorted(map(tuple, found.collect()), key=str) == digest_rows([tuple(r) for r in docs.select("doc_id", "text").collect()], plain)


def test_stored_ids_are_decoded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    stored = bytebpe.encoded(docs, RANKS, PATTERN).unionByName(spark.createDataFrame([(None, None)], "doc_id long, ids binary"))
    found = {r.doc_id: r.decoded for r in bytebpe.decoded(stored, RANKS).collect()}
    assert found == {r.doc_id: bytearray(r.text.encode()) for r in docs.collect()} | {None: None}


def test_empty_table(spark, tmp_path):
    assert bytebpe.encoded(empty(spark, tmp_path), RANKS, PATTERN, decode=True).count() == 0
