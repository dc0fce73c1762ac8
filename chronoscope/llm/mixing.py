"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in a random but fixed order, are cut into blocks of equal
size. A source with weight w (its share of the whole) has block k released at slot
floor(k / w) and due at slot ceil((k + 1) / w); among the released blocks the one
due first gets the next slot. So after any number of slots t, while all sources
last, a source has had more than w t - 1 and fewer than w t + 1 blocks.

Windows repeat: with whole-number weights of sum P, block k + w of a source has the
window of block k moved by P slots. One cycle of P slots is laid out beforehand
(P is bounded by MOST_SLOTS) and every block finds its slot there by arithmetic,
so no step goes through all blocks in order.

With ``each`` the rest isn't one source: a second Pfair level deals the rest's slots
to its sources, which have equal weights there, so its blocks go round: block b of
the r-th of n sources is block b n + r of the rest. After any number of slots each
of them is less than 1 + 1 / n blocks from its share, w / n of the whole. Every
source of any name is scheduled by itself, and their number has no bound.

Running sizes within a source come from two levels: within buckets of documents
dealt by a hash (no bucket is larger because its source is), then over the bucket
totals. Nothing is grouped by source alone.

Defined results: every row gets a place, none is dropped or repeated; slots of a
source that has run out stay empty and the rest keep their order; a source not
named in the weights, or null, belongs to the rest, which is one source (with
``each``, null is a source of the rest); a null
text or size counts as 0; a text longer than a block begins in one and leaves the
next ones of its source empty; equal ids are ordered by row number, and rows without
id are dealt by it; an empty table gives an empty result; further columns are not
read (``mixture`` returns them, whatever their names).
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoscope.llm.shared import in_file_order, quoted, unused, written

#: The rest of the sources, in weights and in ``mix_source``.
REST = "*"
#: Production weights: the largest source is held to 6 in 32, five more are named, the rest share 14.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2, REST: 14}
#: Characters of a block.
BLOCK_SIZE = 16_384
#: Slots of a cycle at most, so that its table has a bounded size.
MOST_SLOTS = 65_536
#: Buckets at least, and documents of a bucket from which on there are more.
LEAST_BUCKETS, BUCKET_DOCUMENTS = 1024, 100_000

ROW = "mix_row"


def cycle(weights: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot of one cycle; blocks of a source count from 0."""
    if not weights or any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    shares = {s: w // gcd(*weights.values()) for s, w in weights.items()}
    slots = sum(shares.values())
    if slots > MOST_SLOTS:
        raise ValueError(f"the weights' sum, without their common divisor, is {slots}; at most {MOST_SLOTS} is possible")
    waiting = [(k * slots // w, -(-(k + 1) * slots // w), s, k) for s, w in shares.items() for k in range(w)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, k))
        out.append(heapq.heappop(ready)[1:])
    return out


def placed(docs: DataFrame, weights: dict[str, int] | None = None, size: Column | None = None, block_size: int = BLOCK_SIZE, seed: int = 1, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", each: bool = False, row: Column | None = None) -> DataFrame:
    """A row for each document: mix_row, doc_id, mix_source, block, slot and place (order within the slot).

    Ordering by slot and place gives the mixture. ``size`` is a document's size, by
    default its text's characters; a document lies in the block in which it begins.
    ``each`` schedules every source of the rest by itself; mix_source is then its own name.
    mix_row is ``row``, a number that each row has for itself, by default its place in the order of the files."""
    spark = docs.sparkSession
    weights = weights or WEIGHTS
    if REST not in weights:
        raise ValueError(f"the weights need one for the rest of the sources, {REST!r}")
    pattern = cycle(weights)
    share = {s: sum(x == s for x, _ in pattern) for s in weights}
    slots = spark.createDataFrame([(s, k, i, share[s]) for i, (s, k) in enumerate(pattern)], "mix_weight string, step long, in_cycle long, share long")
    named = [s for s in weights if s != REST]
    text = F.col(source_column).cast("string")
    source = F.coalesce(text, F.lit(REST)) if each else F.when(text.isin(named), text).otherwise(REST)
    size = F.length(F.col(text_column).cast("string")) if size is None else size
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_DOCUMENTS))
    if row is None:
        row = F.col(unused(docs, ROW))
        docs = in_file_order(docs, unused(docs, ROW))
    rows = docs.select(row.alias(ROW), F.col(id_column).cast("long").alias("doc_id"), source.alias("mix_source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col(ROW).cast("string"))))))
    rows = rows.withColumn("bucket", F.conv(F.left("key", F.lit(8)), 16, 10).cast("long") % buckets)
    rows = written(rows, "mix-rows")
    order = Window.partitionBy("bucket", "mix_source").orderBy("key", "doc_id", ROW)
    inside = rows.repartition("bucket").withColumn("before", F.sum("size").over(order) - F.col("size")).withColumn("nth", F.row_number().over(order))
    totals = rows.groupBy("mix_source", "bucket").agg(F.sum("size").alias("total"))
    upto = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("mix_source", "bucket", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    of_rest = ~F.col("mix_source").isin(named)
    if each:
        others = totals.where(of_rest).select("mix_source").distinct()
        others = others.select("mix_source", (F.row_number().over(Window.orderBy("mix_source")) - 1).alias("nth_other"), F.count("*").over(Window.partitionBy()).alias("others"))
        totals = totals.join(others, "mix_source", "left")
    begun = inside.join(totals, ["mix_source", "bucket"]).withColumn("block", F.expr(f"(base + before) div {block_size}"))
    begun = begun.withColumn("mix_weight", F.when(of_rest, REST).otherwise(F.col("mix_source")))
    begun = begun.withColumn("due", F.when(of_rest, F.expr("block * others + nth_other")).otherwise(F.col("block")) if each else F.col("block"))
    begun = begun.join(F.broadcast(slots.select("mix_weight", "share").distinct()), "mix_weight")
    found = begun.withColumn("step", F.expr("due % share")).join(F.broadcast(slots.select("mix_weight", "step", "in_cycle")), ["mix_weight", "step"])
    slot = F.expr(f"(due div share) * {len(pattern)} + in_cycle")
    return found.select(ROW, "doc_id", "mix_source", "block", slot.alias("slot"), F.struct("bucket", "key", "doc_id", "nth").alias("place"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The input's rows in the mixture's order, as ordered ranges of partitions: files written from it follow each other in that order."""
    row, slot, place = (unused(docs, x) for x in (ROW, "mix_slot", "mix_place"))
    numbered = in_file_order(docs, row)
    at = placed(numbered, row=F.col(row), **options).select(F.col(ROW).alias(row), F.col("slot").alias(slot), F.col("place").alias(place))
    return numbered.join(at, row).repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(*map(quoted, docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``placed`` with its default parameters over ``documents``, bucket and nth standing for the place.

    The cycle's slots are given as values; running sizes come from one window for each source."""
    pattern = cycle(WEIGHTS)
    share = {s: sum(x == s for x, _ in pattern) for s in WEIGHTS}
    values = ", ".join(f"('{s}', {k}, {i}, {share[s]})" for i, (s, k) in enumerate(pattern))
    named = ", ".join(f"'{s}'" for s in WEIGHTS if s != REST)
    return f"""WITH slots(mix_source, step, in_cycle, share) AS (VALUES {values}),
r AS (SELECT doc_id, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS mix_source, coalesce(length(text), 0) AS size, md5('1:' || doc_id) AS key FROM documents),
b AS (SELECT *, CAST('0x' || key[1:8] AS BIGINT) % (SELECT greatest({LEAST_BUCKETS}, (count(*) + {BUCKET_DOCUMENTS - 1}) // {BUCKET_DOCUMENTS}) FROM documents) AS bucket FROM r),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY mix_source ORDER BY bucket, key, doc_id) - size AS BIGINT) // {BLOCK_SIZE} AS block, CAST(row_number() OVER (PARTITION BY bucket, mix_source ORDER BY key, doc_id) AS INT) AS nth FROM b)
SELECT doc_id, mix_source, block, (block // share) * {len(pattern)} + in_cycle AS slot, bucket, nth
FROM o JOIN slots USING (mix_source) WHERE step = block % share"""
