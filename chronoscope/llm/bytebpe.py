"""Byte-level BPE by ranks, encoded and decoded with a sentencepiece model made from the vocabulary.

The model is written as it is: every token of the rank file is a piece whose bytes are
mapped to one sign each, its score is its negative rank, and the normaliser is the
identity. No training takes place. Sentencepiece then merges the pair of highest
score first, the left one of equals, which is what merging by rank does.

A text is cut by the vocabulary's pattern and each match is encoded by itself. A match
that is a token as a whole is that token; the few tokens that merges alone don't
reach are found when the model is made. Decoding maps each id's piece back to bytes.

Defined results: a null or empty text has no ids; ids of texts of any length are
whole (a text is read in windows); repeated rows and null ids stay rows of their own;
an empty table gives an empty result; further columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.chunks import ChunkTable
from chronoscope.llm.shared import plain, slices, tidy

# Fields of the model's messages and the types of pieces, as sentencepiece's file format has them.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def signs() -> list[str]:
    """A sign for each byte: printable ones for themselves, others from U+0100 on; no white space among them."""
    return [chr(b) if 33 <= b < 127 else chr(256 + b) for b in range(256)]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialized_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i is the token of rank i; the one piece more is the unknown one, which no text has."""
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << 24:
        raise ValueError("ranks must be 0, 1, 2 and so on, fewer than 2^24: scores are 32-bit floats")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    sign, out = signs(), []

    def piece(text: str, score: float, kind: int) -> None:
        out.append(_message(PIECES, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)))

    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece("".join(sign[b] for b in token), -float(rank), NORMAL)
    piece("<unk>", 0.0, UNKNOWN)
    trainer = _number(3, BPE) + _number(4, len(ranks) + 1)
    normalizer = _message(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))  # no prefix, no white space removed or escaped
    return b"".join(out) + _message(TRAINER, trainer) + _message(NORMALIZER, normalizer)


class ByteCodec:
    """Encodes and decodes by a rank file and a pattern; a task makes its own."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("ids are kept as this machine's own 32-bit integers, which must be little-endian")
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(ranks))
        sign = signs()
        self.mapped = str.maketrans({chr(b): sign[b] for b in range(256)})
        back = {s: b for b, s in enumerate(sign)}
        self.tokens = [bytes(back[s] for s in self.model.id_to_piece(i)) for i in range(len(ranks))]
        alone = self.model.encode([self._piece(t) for t in self.tokens], num_threads=1)
        self.whole = {t: [i] for i, (t, ids) in enumerate(zip(self.tokens, alone)) if ids != [i]}
        self.table = ChunkTable(regex.compile(pattern).findall, self._encoded)

    def _piece(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.mapped)

    def _encoded(self, matches: list[str]) -> list[bytes]:
        raw = [m.encode() for m in matches]
        ids = self.model.encode([self._piece(m) for m in raw], num_threads=1)
        return [array("I", self.whole.get(m, i)).tobytes() for m, i in zip(raw, ids)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, each as a little-endian unsigned 32-bit integer."""
        out = [[] for _ in texts]
        for i, values in self.table.of_texts(texts):
            out[i].append(b"".join(values))
        return [b"".join(found) for found in out]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids in the form that ``encode`` gives."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ``ids``, each id in 4 bytes, little-endian; with ``decode`` also ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for part in slices(batch, "t"):
                codec = codec or ByteCodec(ranks, pattern)
                ids = codec.encode(plain(part.column("t")).to_pylist())
                columns = [part.column("d"), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    chosen = docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("t"))
    return chosen.mapInArrow(tidy(run), "doc_id long, ids binary" + ", decoded binary" * decode)


def decoded(rows: DataFrame, ranks: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with a column ``name``: the bytes that stored ids stand for. An id outside the vocabulary ends the job; null stays null.

    The vocabulary is sent to each task and looked up there."""
    tokens = [t for t, _ in sorted(read_ranks(ranks).items(), key=lambda x: x[1])]

    @F.pandas_udf("binary")
    def mapped(column):
        return column.map(lambda x: None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())))

    return rows.withColumn(name, mapped(F.col(ids)))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encoded(..., decode=True)``."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
