"""Alignment of two tokenizers over a corpus: where their tokens end together, and how often two ids do.

A is a byte-level BPE (``tokenizers``), B a sentencepiece BPE that puts a space first.
A task cuts texts at plain white space, and at punctuation after letters, where no token of
either joins what is before and after (the vocabularies are checked for that), so ids and groups of a chunk are
found once and a document's are those of its chunks.

A link joins the two tokens that end at one byte. Links are counted in dense
matrices, a stripe of B ids each: tasks add up their own links, the sums are dealt by
stripe, added with ``np.add.at`` into the stripe's block, and written. Then links meet
the counts of their stripe in one task, whose block gives each link its count and,
by the largest of its row, whether that is its B id's best. A stripe with many
links is dealt to several tasks, each with the stripe's counts.

Only numbers travel: of each slice of documents and stripe the distinct pairs and, for
each pair, its documents and times; the sums come back by slice. A document has one
entry for a pair, however often it repeats it.

Defined results: a null or empty text, or one whose tokens don't give its bytes (a text
with U+2581, say), has zeros and an empty group column; texts of any length count whole;
repeated rows and null ids are rows of their own and count each; an empty table gives an
empty result; further columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.chunks import CHUNK, ChunkTable
from chronoscope.llm.shared import plain, slices, tidy, written

#: Stripes of B ids; links that one task scores; sums that a task holds before it adds equal ones up.
STRIPES, LINKS_A_PART, HELD_SUMS = 128, 16 << 20, 4 << 20
#: Letters that a vocabulary may keep apart from punctuation after them, which makes chunks fewer; bytes of chunks and what is known of them in a task.
LETTERS, CHUNK_BYTES = "A-Za-zÀ-ÖØ-öø-ÿ", 192 << 20
#: Bits of an A id and of a document's number in its slice, in a link's code.
A_BITS, DOC_BITS = 20, 22

LINKS = "slice long, stripe int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, pair binary, docs binary, doc binary, times binary"
COUNTS = "stripe int, pair binary, n binary"
SCORES = "slice long, doc binary, best binary, sum binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Stripes:
    """How B ids are dealt: id b has row b // number of stripe b % number."""

    a_ids: int
    b_ids: int
    number: int

    @property
    def rows(self) -> int:
        return -(-self.b_ids // self.number)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A link as a number that sorts by stripe, row and A id."""
        return (b % self.number * self.rows + b // self.number) << A_BITS | a

    def split(self, codes: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The stripes of sorted codes and where their codes are."""
        bounds = np.searchsorted(codes, np.arange(self.number + 1) * self.rows << A_BITS)
        for stripe in np.flatnonzero(np.diff(bounds)).tolist():
            yield stripe, slice(int(bounds[stripe]), int(bounds[stripe + 1]))

    def cell(self, codes: np.ndarray) -> np.ndarray:
        """A code's place in its stripe's block, which is ``rows`` by ``a_ids``."""
        return (codes >> A_BITS) % self.rows * self.a_ids + (codes & (1 << A_BITS) - 1)


class PairCoder:
    """Both tokenizers, and the tokens, groups and links of chunks; a task makes its own."""

    def __init__(self, a_path: str, b_path: str, stripes: int = STRIPES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        back = {s: b for b, s in _byte_signs().items()}
        self.a_bytes = [bytes(back.get(s, 0) for s in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if joined := [p for p in pieces if re.search(r"[^\s▁][▁ \t\n]", p) or "\n" in p]:
            raise ValueError(f"pieces join signs to white space after them: {joined[:3]}")
        apart = [c for c in string.punctuation if c != "'" and not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in pieces)]
        cut = re.compile(rf"[ \t\n]*[{LETTERS}]+(?=[{re.escape(''.join(apart))}])|{CHUNK.pattern}" if apart else CHUNK.pattern)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.stripes = Stripes(len(self.a_bytes), len(pieces), stripes)
        if self.stripes.a_ids >= 1 << A_BITS or self.stripes.rows * stripes << A_BITS + DOC_BITS >= 1 << 63:
            raise ValueError("vocabularies are too large for a link's code")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in found], np.int64) for found in (self.a_bytes, self.b_bytes))
        #: An id in the text of groups, with what comes after it: another of the same side, the other side, the next group.
        self.shown = [f"{i}{end}" for end in ",|;" for i in range(max(len(self.a_bytes), len(pieces)))]
        self.before_b = len(self.b.encode("\n"))
        self.table = ChunkTable(cut.findall, self._learn, lambda value: len(value[3]) + len(value[4]) + 160 if value[0] else 160, CHUNK_BYTES)

    def _learn(self, chunks: list[str]) -> list[tuple]:
        """(A tokens, B tokens, groups, text of the groups, codes of the links) of each chunk; zeros and a null text where bytes differ.

        B's tokens of a chunk are those after a line's end, which nothing joins to what follows, less that line's own."""
        a_lists = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b_lists = [ids[self.before_b :] for ids in self.b.encode(["\n" + c for c in chunks], num_threads=1)]
        a_raw, b_raw = (list(map(b"".join, map(partial(map, known.__getitem__), lists))) for known, lists in ((self.a_bytes, a_lists), (self.b_bytes, b_lists)))
        good = [x == y == c.encode() for x, y, c in zip(a_raw, b_raw, chunks)]
        chosen = list(itertools.compress(zip(a_lists, b_lists), good))
        found = iter(self._aligned([a for a, _ in chosen], [b for _, b in chosen]))
        return [next(found) if ok else (0, 0, 0, None, b"") for ok in good]

    def _aligned(self, a_lists: list[list[int]], b_lists: list[list[int]]) -> Iterator[tuple]:
        if not a_lists:
            return
        many_a, many_b = (np.array([len(x) for x in lists]) for lists in (a_lists, b_lists))
        a, b = (np.fromiter(itertools.chain.from_iterable(lists), np.int64) for lists in (a_lists, b_lists))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])  # both run over all chunks alike, since the chunks' bytes do
        a_place = np.minimum(np.searchsorted(a_ends, b_ends), len(a) - 1)
        b_last = np.flatnonzero(a_ends[a_place] == b_ends)  # the last B token of each group, and of A
        a_last = a_place[b_last]
        codes = self.stripes.code(a[a_last], b[b_last])
        # The text of the groups: A's and B's ids in turn, each with what follows it.
        n = len(self.shown) // 3
        a_shown, b_shown = a.copy(), b.copy()
        a_shown[a_last] += n
        b_shown[b_last] += 2 * n
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((a_last, a), (b_last, b)))
        b_before, a_until = np.append(0, b_last + 1), a_last + 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[group_a]] = a_shown
        order[np.arange(len(b)) + a_until[group_b]] = b_shown
        shown = list(map(self.shown.__getitem__, order.tolist()))
        a_at, b_at = (np.append(0, np.cumsum(many)) for many in (many_a, many_b))
        groups_at = np.searchsorted(b_last, b_at)
        text_at, links_at = (a_at + b_at).tolist(), groups_at.tolist()
        raw = codes.tobytes()
        for i, (na, nb) in enumerate(zip(many_a.tolist(), many_b.tolist())):
            yield na, nb, links_at[i + 1] - links_at[i], "".join(shown[text_at[i] : text_at[i + 1]]), raw[8 * links_at[i] : 8 * links_at[i + 1]]

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Each text's numbers of A tokens, B tokens and groups; the digests of their groups; the links' codes and their texts' numbers."""
        counts, digests, links = np.zeros((len(texts), 3), np.int64), [hashlib.sha256() for _ in texts], [[] for _ in texts]
        held, bad = [""] * len(texts), np.zeros(len(texts), bool)
        for i, values in self.table.of_texts([" " + t if t else "" for t in texts]):
            if bad[i] or None in (columns := list(zip(*values)))[3]:
                bad[i] = True
                continue
            counts[i] += [sum(columns[0]), sum(columns[1]), sum(columns[2])]
            shown = held[i] + "".join(columns[3])
            digests[i].update(shown[:-1].encode())  # the text's very last sign isn't followed by a group
            held[i] = shown[-1:]
            links[i].append(b"".join(columns[4]))
        counts[bad] = 0
        raw = [b"" if bad[i] else b"".join(found) for i, found in enumerate(links)]
        shas = [digest.hexdigest() if counts[i, 0] else "" for i, digest in enumerate(digests)]
        return counts, shas, np.frombuffer(b"".join(raw), np.int64), np.repeat(np.arange(len(texts)), [len(x) // 8 for x in raw])


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in turn from U+0100 on."""
    out, more = {}, 256
    for byte in range(256):
        if 33 <= byte < 127 or 161 <= byte < 173 or 174 <= byte:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(more)
            more += 1
    return out


def linked(docs: DataFrame, a_path: str, b_path: str, id_column: str, text_column: str, stripes: int) -> DataFrame:
    """For each slice of documents a row with what is known of them, and a row for each stripe with the links' pairs.

    A pair's ``docs`` says how many entries it has, an entry is a document (its number in the slice) and how many ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "t"):
                coder = coder or PairCoder(a_path, b_path, stripes)
                counts, shas, codes, doc = coder.documents(plain(part.column("t")).to_pylist())
                rows = [{"slice": number, "stripe": -1, "doc_id": part.column("d").to_pylist(), "n_a": counts[:, 0].tolist(), "n_b": counts[:, 1].tolist(), "n_groups": counts[:, 2].tolist(), "groups_sha256": shas}]
                entries, times = np.unique(codes << DOC_BITS | doc, return_counts=True)
                all_pairs = entries >> DOC_BITS
                for stripe, at in coder.stripes.split(all_pairs):
                    first = np.flatnonzero(np.diff(all_pairs[at], prepend=-1))
                    many = np.diff(np.append(first, at.stop - at.start))
                    fields = {"pair": all_pairs[at][first], "docs": many.astype("<u4"), "doc": (entries[at] & (1 << DOC_BITS) - 1).astype("<u4"), "times": times[at].astype("<u4")}
                    rows.append({"slice": number, "stripe": stripe} | {k: v.tobytes() for k, v in fields.items()})
                number += 1
                yield from _batches(rows, schema)

    schema = _arrow(LINKS)
    return docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("t")).mapInArrow(tidy(run), LINKS)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batches(rows: list[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        yield pa.RecordBatch.from_pylist(rows[i : i + most], schema=schema)


def _numbers(value: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(value, kind)


def _summed(codes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of each."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate(sums))
    return distinct, total


def pair_counts(links: DataFrame, stripes: Stripes, cells_a_row: int = 1 << 20) -> DataFrame:
    """(stripe, pair, n): how many links hold each pair, as arrays of bounded length."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, held = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                codes.append(_numbers(row["pair"]))
                starts = np.cumsum(_numbers(row["docs"], "<u4"), dtype=np.int64)
                sums.append(np.add.reduceat(_numbers(row["times"], "<u4").astype(np.int64), np.append(0, starts[:-1])))
                held += len(codes[-1])
                if held > HELD_SUMS:
                    codes, sums = ([x] for x in _summed(codes, sums))
                    held = len(codes[0])
                    if held > HELD_SUMS // 2:
                        yield from given(codes, sums)
                        codes, sums, held = [], [], 0
        yield from given(codes, sums)

    def given(codes: list[np.ndarray], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        distinct, total = _summed(codes, sums)
        yield from _batches([{"stripe": stripe, "pair": distinct[at].tobytes(), "n": total[at].tobytes()} for stripe, at in stripes.split(distinct)], schema)

    def whole(stripe: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = np.flatnonzero(block)
        codes = (stripe * stripes.rows + cells // stripes.a_ids) << A_BITS | cells % stripes.a_ids
        for at in range(0, len(cells), cells_a_row):
            here = slice(at, at + cells_a_row)
            yield from _batches([{"stripe": stripe, "pair": codes[here].tobytes(), "n": block[cells[here]].tobytes()}], schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros(stripes.rows * stripes.a_ids, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["stripe"] != stripe:
                    if stripe is not None:
                        yield from whole(stripe, block)
                        block[:] = 0
                    stripe = row["stripe"]
                np.add.at(block, stripes.cell(_numbers(row["pair"])), _numbers(row["n"]))
        if stripe is not None:
            yield from whole(stripe, block)

    schema = _arrow(COUNTS)
    partial = links.where("stripe >= 0").select("stripe", "pair", "docs", "times").mapInArrow(tidy(own), COUNTS)
    return partial.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(tidy(added), COUNTS)


def scored(links: DataFrame, counts: DataFrame, stripes: Stripes, links_a_part: int = LINKS_A_PART) -> DataFrame:
    """(slice, doc, best, sum) of each row of links: each entry's document, its links that are their B id's best, the sum of their counts.

    Links of a stripe are dealt to as many tasks as their number asks; each gets the stripe's counts first."""
    sizes = links.where("stripe >= 0").groupBy("stripe").agg(F.sum(F.octet_length("doc") / 4).alias("n")).collect()  # a row a stripe
    parts = {row["stripe"]: max(1, round(row["n"] / links_a_part)) for row in sizes}
    if not parts:
        return links.sparkSession.createDataFrame([], SCORES)
    many = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("stripe"))
    facts = counts.select("stripe", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), F.lit(-1).cast("long").alias("slice"), "pair", "n")
    own = links.where("stripe >= 0").select("stripe", F.pmod(F.xxhash64("slice"), many).cast("int").alias("part"), "slice", "pair", "docs", "doc", "times")
    dealt = facts.unionByName(own, allowMissingColumns=True).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, at = np.zeros((stripes.rows, stripes.a_ids), np.int64), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["stripe"], row["part"]) != at:
                    at, best = (row["stripe"], row["part"]), None
                    block[:] = 0
                pair = _numbers(row["pair"])
                cells = stripes.cell(pair)
                if row["slice"] < 0:
                    np.add.at(block.reshape(-1), cells, _numbers(row["n"]))
                    continue
                if best is None:
                    best = block.max(axis=1)
                n = block.reshape(-1)[cells]
                docs = _numbers(row["docs"], "<u4")
                doc, times = _numbers(row["doc"], "<u4"), _numbers(row["times"], "<u4").astype(np.int64)
                count = np.repeat(n, docs) * times
                is_best = np.repeat(n == best[cells // stripes.a_ids], docs)
                distinct, place = np.unique(doc, return_inverse=True)
                sums, bests = np.zeros((2, len(distinct)), np.int64)
                np.add.at(sums, place, count)
                np.add.at(bests, place, times * is_best)
                yield pa.RecordBatch.from_pylist([{"slice": row["slice"], "doc": distinct.tobytes(), "best": bests.astype("<u4").tobytes(), "sum": sums.tobytes()}], schema=schema)

    schema = _arrow(SCORES)
    return dealt.mapInArrow(tidy(run), SCORES)


def _by_document(links: DataFrame, scores: DataFrame) -> DataFrame:
    """Sums of the scores beside what is known of each slice's documents, a slice at a time."""
    known = links.where("stripe < 0").select("slice", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.lit(0).alias("kind"))
    dealt = known.unionByName(scores.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> pa.RecordBatch:
            columns = [head["doc_id"], head["n_a"], head["n_b"], head["n_groups"], head["n_groups"], sums[0], sums[1], head["groups_sha256"]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        head = sums = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if head:
                        yield whole()
                    head, sums = row, np.zeros((2, len(row["doc_id"])), np.int64)
                else:
                    doc = _numbers(row["doc"], "<u4")
                    sums[0, doc] += _numbers(row["best"], "<u4")
                    sums[1, doc] += _numbers(row["sum"])
        if head:
            yield whole()

    schema = _arrow(ALIGNED)
    return dealt.mapInArrow(tidy(run), ALIGNED)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", stripes: int = STRIPES, links_a_part: int = LINKS_A_PART) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document, as the module says.

    A group has one link: tokens have at least a byte, so one of each side ends where it ends."""
    coder = PairCoder(a_path, b_path, stripes)
    links = written(linked(docs, a_path, b_path, id_column, text_column, stripes), "links", compression="zstd")
    counts = written(pair_counts(links, coder.stripes), "pair-counts", compression="zstd")
    return _by_document(links, scored(links, counts, coder.stripes, links_a_part))


def count_rows(counts: DataFrame, stripes: Stripes) -> DataFrame:
    """(a, b, n, best): the pairs of ``pair_counts`` a row each, and whether a pair is its B id's most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = _numbers(row["pair"])
                b = (codes >> A_BITS) % stripes.rows * stripes.number + row["stripe"]
                yield pa.RecordBatch.from_arrays([pa.array(codes & (1 << A_BITS) - 1), pa.array(b), pa.array(_numbers(row["n"]))], names=["a", "b", "n"])

    found = counts.mapInArrow(tidy(run), "a long, b long, n long")
    most = found.groupBy("b").agg(F.max("n").alias("most"))
    return found.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
