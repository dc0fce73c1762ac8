"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text, without its ASCII white space, is cut where its own content says so. Its
recipe is the ordered list of its chunks' identifiers, and texts are equal exactly
when their recipes are. Identifiers are 64-bit hashes that are verified: distinct
chunks are gathered once, copies combined before the shuffle, and the hashes that
stand for several different chunks are listed (n chunks have about n * n / 2 ** 65
of these: 70 among 5e10). A recipe with such a hash has the chunk itself beside it,
and no other chunk moves again. After that recipes move, not texts.

Defined results: a null text counts as empty and all empty texts are one group; a
very long text has a longer recipe, nothing else; a null id loses against any other;
of rows that are alike in all, ids included, exactly one stays; an empty table gives
an empty result; further columns are not read (``unique_documents`` returns them,
whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.shared import in_file_order, quoted, unused, written

#: The white space that texts are compared without.
BLANKS = r"[\x20\x09-\x0D]+"
#: A chunk has at least and at most so many characters (and five), and ends where two characters follow each other
#: as they did three places before, if it can: that happens in any script. Where there are thousands of signs
#: (from CJK radicals to Hangul syllables), one is enough.
LEAST, MOST = 1024, 8192
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:(.)(.).\1\2|([\u2E80-\uD7FF])..\3)|.{{1,{MOST}}}"

ROW = "dedup_row"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def shared_hashes(docs: DataFrame, text_column: str) -> list[int]:
    """The hashes that belong to several different chunks of the table."""
    chunk = docs.select(F.explode(chunks(normalised(F.col(text_column)))).alias("chunk"))
    distinct = chunk.select(identifier(F.col("chunk")).alias("hash"), "chunk").distinct()
    return [r["hash"] for r in distinct.groupBy("hash").count().where("count > 1").select("hash").collect()]


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: Column | None = None) -> DataFrame:
    """A row for each document: row number, id, characters of the original text, digest of the normalised text, recipe, and the chunks whose hashes others have too."""
    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias(ROW),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.length(F.col(text_column).cast("string")), F.lit(0)).alias("chars"),
        normalised(F.col(text_column)).alias("norm"),
    )
    cut = rows.select(ROW, "doc_id", "chars", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    several = shared_hashes(docs, text_column)
    doubtful = F.filter("chunks", lambda x: F.array_contains(F.lit(several), identifier(x))) if several else F.lit(None).cast("array<string>")
    return cut.select(ROW, "doc_id", "chars", "text_sha256", F.transform("chunks", identifier).alias("recipe"), doubtful.alias("doubtful"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: Column | None = None) -> DataFrame:
    """A row for each document: dedup_row, doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    Of equal texts the one with the most characters, then the smallest id, then the
    smallest row number, stays. dedup_row is ``row``, a number that each row has for
    itself, or one that this run alone gives."""
    keyed = written(recipes(docs, id_column, text_column, row), "recipes")
    best = F.max(F.struct("chars", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id").alias("low_id"), F.bitwise_not(ROW).alias("low_row")))
    groups = keyed.groupBy("recipe", "doubtful").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    # A written table has no partitioning of its own, so Spark deals both sides for the join and can split a skewed key.
    groups = written(groups.select(F.col("recipe").alias("r"), F.col("doubtful").alias("d"), "group_size", F.bitwise_not("best.low_id").alias("keep_id"), F.bitwise_not("best.low_row").alias("keep_row")), "groups")
    joined = keyed.join(groups, (keyed["recipe"] == groups["r"]) & keyed["doubtful"].eqNullSafe(groups["d"]), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        ROW,
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col(ROW))).alias("kept"),
        "text_sha256",
    )


def unique_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input's rows without those that an equal text replaces."""
    row = unused(docs, ROW)
    numbered = in_file_order(docs, row)
    kept = exact_duplicates(numbered, id_column, text_column, F.col(row)).where("kept").select(F.col(ROW).alias(row))
    return numbered.join(kept, row, "left_semi").select(*map(quoted, docs.columns))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
