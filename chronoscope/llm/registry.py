"""The corpus operators' queries by name, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoscope.llm.shared import documents

#: Names of the tokenizer files that the queries use: of packing and token files, of byte-level BPE, and the two that are aligned.
TOKENIZER_FILE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
ALIGNED_FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.dedup import ROW, exact_duplicates

    return exact_duplicates(documents(spark, sf_dir)).drop(ROW)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.near import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_size")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.tokenfiles import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path())


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.media import stored_text_media

    return stored_text_media(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.pii import pii_digest

    return pii_digest(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.language import identified_documents

    return identified_documents(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from chronoscope.llm.mixing import placed

    found = placed(documents(spark, sf_dir))
    return found.select("doc_id", "mix_source", "block", "slot", F.col("place.bucket").alias("bucket"), F.col("place.nth").alias("nth"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.brown import brown_scores

    return brown_scores(documents(spark, sf_dir))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronoscope.llm.bytebpe import digests, encoded

    return digests(encoded(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, decode=True))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronoscope.llm.alignment import aligned

    return aligned(documents(spark, sf_dir), *map(public_tokenizers.path, ALIGNED_FILES))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoscope.llm.audit import filter_audit

    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Queries in the order of the operators' numbers.
QUERIES = [op1_packing, op2_exact_dedup, op3_ngram_jaccard_join, op4_quality_classifier, op5_token_files, op6_media_columns, op7_pii, op8_language_id, op9_source_mixing, op10_lm_scoring, op11_byte_bpe, op12_tokenizer_alignment, op13_filter_audit]


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    from chronoscope.llm import audit, dedup, mixing, pii

    return {"op13_filter_audit": audit.ORACLE_SQL, "op2_exact_dedup": dedup.ORACLE_SQL, "op7_pii": pii.oracle_sql(), "op9_source_mixing": mixing.oracle_sql()}
