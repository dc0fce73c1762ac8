"""Alignment of two tokenizers against encodings of whole texts and links counted in a dictionary."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from chronoscope.llm import alignment
from tests.llm.odd import empty, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, straight from the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder, b_coder = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_coder.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    sign = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def b_bytes(i):
        piece = b_coder.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = [(i, bytes(sign[c] for c in a_coder.id_to_token(i))) for i in a_coder.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in b_coder.encode(text)] if text else []
        if not text or not b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
            found.append(None)
            continue
        groups, links, ends = [], [], []
        for side in (a, b):
            at, places = 0, {}
            for i, raw in side:
                at += len(raw)
                places[at] = i
            ends.append(places)
        shared = sorted(set(ends[0]) & set(ends[1]))
        at = [[0, 0], [0, 0]]
        for stop in shared:
            group = []
            for k, side in enumerate((a, b)):
                ids = []
                while at[k][1] < stop:
                    ids.append(side[at[k][0]][0])
                    at[k] = [at[k][0] + 1, at[k][1] + len(side[at[k][0]][1])]
                group.append(",".join(map(str, ids)))
            groups.append("|".join(group))
            links.append((ends[0][stop], ends[1][stop]))
        found.append((len(a), len(b), groups, links))
    counts = Counter(link for x in found if x for link in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((a, b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def texts_of(seed, many, signs="ab the 1 \n\t\r▁́é漢\U0001f600 \x1c.<|endoftext|>"):
    rng = random.Random(seed)
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(many)] + ["<|endoftext|> <s>", "the the the", None, "", " ", "\n", "  the", "a▁b", "the end \r\n\r\nof"]


@pytest.mark.parametrize("stripes,part", [(128, 1 << 20), (7, 50)])
def test_whole_texts(spark, stripes, part):
    texts = texts_of(stripes, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((i, *row) for i, row in enumerate(plain([t or "" for t in texts])))
    assert result(alignment.aligned(docs, A, B, stripes=stripes, links_a_part=part)) == want


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows])))
    assert result(alignment.aligned(docs, A, B)) == want


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names."""
    docs = table(spark, tmp_path)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, plain([r.text or "" for r in rows]))), key=str)
    assert sorted(map(tuple, alignment.aligned(docs, A, B).collect()), key=str) == want


def test_empty_table(spark, tmp_path):
    assert alignment.aligned(empty(spark, tmp_path), A, B).count() == 0


def test_long_text_and_hot_pair(spark, monkeypatch):
    """A text of many windows; a pair that holds most links, dealt to several tasks, with sums given out early."""
    monkeypatch.setattr(alignment, "HELD_SUMS", 3)
    texts = ["the quick\nbrown " * 40_000, *["the"] * 500, *["quick brown"] * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted((i, *row) for i, row in enumerate(plain(texts)))
    assert result(alignment.aligned(docs, A, B, stripes=5, links_a_part=10)) == want


def test_counts_as_rows(spark):
    texts = ["the end", "the end of the end", "an end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coder = alignment.PairCoder(A, B, 9)
    links = alignment.linked(docs, A, B, "doc_id", "text", 9)
    rows = alignment.count_rows(alignment.pair_counts(links, coder.stripes), coder.stripes).collect()
    assert sum(r.n for r in rows) == sum(x[3] for x in plain(texts))
    the = coder.a.token_to_id("Ġthe"), coder.b.piece_to_id("▁the")
    assert [(r.n, r.best) for r in rows if (r.a, r.b) == the] == [(3, True)]


def test_pieces_that_cross_white_space_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b" if i == 500 else real(self, i))
    with pytest.raises(ValueError, match="white space"):
        alignment.PairCoder(A, B)
