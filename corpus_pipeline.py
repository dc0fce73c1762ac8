"""A training corpus from raw documents: five stages, each over all that the one before kept.

language      documents whose text has no letter, or for which no language can be learned, go
exact         of equal texts one stays
near          of each component of similar texts (five words, Jaccard 0.8) one stays
mixing        documents follow each other as the sources' target weights ask, each source by itself; none goes
packing       token pieces with their places in sequences of 2048 ids, which follow the mixture
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.llm.dedup import unique_documents
from chronoscope.llm.language import UNDECIDED, identified_documents
from chronoscope.llm.mixing import mixture
from chronoscope.llm.near import without_near_duplicates
from chronoscope.llm.packing import pack
from chronoscope.llm.registry import tokenizer_path
from chronoscope.llm.shared import documents, in_file_order, quoted, remove_scratch, scratch_mark, unused, written

#: What the language stage works on; other columns go past it, whatever their names.
READ = ["doc_id", "text", "lang"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language. A null, empty or letterless text goes, and all go where no language can be learned.

    Each row is decided by itself, so repeated rows and ids go or stay alike; a text of
    any length counts as a whole; an empty table stays empty; columns of any name pass."""
    more = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in READ)) if set(docs.columns) - set(READ) else F.lit(None)
    kept = identified_documents(docs.select(*READ, more.alias("more"))).where(F.col("lang_pred") != UNDECIDED)
    return kept.select(*((F.col(c) if c in READ else F.col(f"more.c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (without white space): the one with the most characters, then the smallest id, then the first row.

    Null counts as empty, so all empty texts leave one row; a null id loses against any
    other; of rows alike in all one stays; texts of any length; an empty table stays
    empty; columns of any name pass."""
    return unique_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: the smallest id, of repeated ids the first row.

    A null, empty or wordless text is similar to nothing and stays; rows of a
    component without any id stay; texts of any length; an empty table stays
    empty; columns of any name pass."""
    return without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order that the sources' weights ask.

    A null source is a source of its own; a null or empty text has size 0; a text longer
    than a block begins in one; equal ids follow the order of rows; repeated rows all
    stay; an empty table stays empty; columns of any name pass."""
    return mixture(docs, each=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and places. Their order, which the mixing stage decides, is that of the files read here.

    A null or empty text is one piece of the end id; a long one has several pieces;
    equal pieces go by place; repeated rows and ids and null ids are packed each for
    itself; an empty table gives no piece; columns of any name aren't read."""
    place = unused(docs, "mix_place")
    return pack(in_file_order(docs, place), tokenizer_path(), order=place)


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Tokenizing and the mixture's schedule have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written to the shared folder and read again, and what they needed meanwhile goes."""
    docs, mark = documents(spark, sf_dir), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_scratch(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
