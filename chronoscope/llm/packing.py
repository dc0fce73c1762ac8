"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids are cut into pieces of at most one sequence. The pieces are written,
counted and dealt to random groups of about GROUP_DOCUMENTS (by a hash with a seed and
each piece's number, so that pieces of repeated or missing ids spread too) and each
group is packed by itself: longest first, each piece into the first sequence with
room, which a tournament tree over the sequences' free room finds in logarithmic
time. Groups are independent, so their number grows with the pieces and their size doesn't.

Where documents have an order (a mixture), a group is a range of as many documents
that follow each other, groups are numbered in that order, and a group's sequences
follow each other as the pieces that open them do. A range with more than half as
many pieces again (long documents) is dealt to several groups.

Only (id, length, checksum) rows are written and shuffled, unless ``with_ids`` is set.

Defined results: a null or empty text is one piece with the end id alone; a very long
text has as many pieces as it needs, which may lie in different groups; a null id
stays null; rows with the same id and text are packed each for itself; pieces of
equal length go by place, id and start; an empty table gives an empty result; further
columns of the input are not read, so their names don't matter.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.encoder import WordEncoder
from chronoscope.llm.shared import plain, slices, tidy, written

#: Ids of a sequence; pieces of a randomised group and documents of a range; the id after each document's own.
CAPACITY, GROUP_DOCUMENTS, END_ID = 2048, 4096, 1

#: Text bytes encoded at a time: the more, the fewer distinct words are looked up.
ENCODE_BYTES = 4 << 20
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
PLACE = "pack_place"
#: Bits of a sequence_id for the sequence in its group, and of a group's number for the part of its range.
SEQUENCE_BITS, PART_BITS = 20, 16


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each length and the free room of each bin. Equal lengths keep their order."""
    if not lengths:
        return [], []
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # an inner node has the larger room of its two children
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i] = node - leaves
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    used = max(bins) + 1
    return bins, tree[leaves : leaves + used]


def token_pieces(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, capacity: int, end_id: int, with_ids: bool, order: str | None = None) -> DataFrame:
    """Each document's ids, with the end id, cut every ``capacity`` ids: a row for each piece, with its checksum and, with ``order``, its document's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part in slices(batch, "t", ENCODE_BYTES):
                coder = coder or WordEncoder(tokenizer)
                ids, bounds = coder.encode(plain(part.column("t")))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                totals = np.diff(bounds)
                counts = -(-totals // capacity)
                row = np.repeat(np.arange(len(totals)), counts)
                start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
                cuts = np.append(bounds[row] + start, len(ids))
                data = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in itertools.pairwise(cuts.tolist())), np.int64, len(row))
                columns = [part.column("d").take(pa.array(row)), pa.array(start), pa.array(np.diff(cuts)), pa.array(crc), pa.array(totals[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names = PIECE_NAMES[: len(columns)]
                if order:
                    columns.append(part.column("o").take(pa.array(row)))
                    names = [*names, PLACE]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + f", {PLACE} long" * bool(order)
    place = [F.col(order).cast("long").alias("o")] if order else []
    return docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("t"), *place).mapInArrow(tidy(run), schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS,
    seed: int = 1,
    with_ids: bool = False,
    order: str | None = None,
) -> DataFrame:
    """A row for each piece of a document: its place in the document and in a sequence of at most ``capacity`` ids.

    doc_id, start (the document's ids before the piece), length, ids_crc32 (of the
    piece's ids as little-endian 32-bit), doc_tokens (ids of the document, end id
    included), sequence_id (unique in the result), offset (in the sequence, without
    gaps from 0) and, with ``with_ids``, the ids themselves.

    ``group_documents`` is about how many pieces a group has, or how many documents a range.
    ``order`` names a column of the documents' numbers in an order, from 0: sequences
    of ascending sequence_id then follow that order, range by range, and nothing is
    dealt at random. Without it the order of the rows has no effect."""
    if not 0 < group_documents < 1 << SEQUENCE_BITS - 2:
        raise ValueError(f"group_documents must be from 1 to {(1 << SEQUENCE_BITS - 2) - 1}")
    pieces = token_pieces(docs, tokenizer, id_column, text_column, capacity, end_id, with_ids, order)
    pieces = written(pieces.withColumn("pack_piece", F.monotonically_increasing_id()), "pieces")
    deal = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "pack_piece")
    if order:
        pieces = pieces.withColumn("pack_range", F.floor(F.col(PLACE) / group_documents))
        parts = pieces.groupBy("pack_range").agg(F.greatest(F.lit(1), F.round(F.count("*") / group_documents)).cast("long").alias("pack_parts"))
        pieces = pieces.join(parts, "pack_range")
        group = F.shiftleft("pack_range", PART_BITS) + F.pmod(deal, F.col("pack_parts"))
    else:
        group = F.pmod(deal, F.lit(max(1, -(-pieces.count() // group_documents))))
    place = [PLACE] if order else []
    dealt = pieces.select(*PIECE_NAMES[: 6 if with_ids else 5], *place, group.alias("pack_group"))

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in place), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = rows.column("length").to_pylist()
        bins = np.array(first_fit_decreasing(lengths, capacity)[0], np.int64)
        if place:
            opens = np.unique(bins, return_index=True)[1]
            places, starts = (rows.column(c).to_numpy()[opens] for c in (PLACE, "start"))
            bins = np.argsort(np.lexsort((starts, places)))[bins]
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(np.array(lengths)[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        before = ends - np.array(lengths)[order]
        offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
        out = rows.drop(["pack_group", *place]).take(pa.array(order))
        sequence = bins[order] + (group[0].as_py() << SEQUENCE_BITS)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The ids of each sequence of ``pack(..., with_ids=True)``, padded to ``capacity``: a group holds at most that many ids."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.size("ids").alias("n_ids"), F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - F.size("ids"))).alias("ids"))
