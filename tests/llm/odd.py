"""A small table of documents with everything that tends to break operators, and what tests share."""

from __future__ import annotations

import random

LONG = "x" * 150_000
PHRASE = "the quick brown fox jumps over the lazy dog while nine old men drink cold tea near the big river "

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, slot int, x int, pii string"


def rows(with_null_id: bool = True) -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    texts = [
        (1, None), (2, ""), (3, "  \t\n "), (4, LONG), (5, PHRASE * 3), (6, PHRASE * 3), (7, PHRASE * 3 + "end"), (8, PHRASE.upper() * 3),
        (9, "one"), (10, "one two"), (11, "one two"), (12, "one  two"), (13, "ONE TWO"), (14, "one two three"), (15, " ".join(words)), (16, " ".join(words[:-3])),
        (17, "123 456 !!! ---"), (18, "été 中文 \U0001f600 naïve é"), (19, "a b c\x85d\x0be\x0cf"), (20, PHRASE * 3), (20, PHRASE * 3), (21, "left"), (21, "right"),
        (22, "<|endoftext|> it's <|startoftext|>x don't"), (-5, "negative id here"), (23, "9" * 20_000), (24, "\0\x01 control"), (25, " ".join(words[:1500]) + " tail " * 5),
    ]
    if with_null_id:
        texts += [(None, "no id"), (None, PHRASE * 3)]
    return [(i, t, ("en", "fr", None)[k % 3], ("src0", "src1", None, "zzz")[k % 4], None, 0.5, "r", 3, 4, "p") for k, (i, t) in enumerate(texts)]


def table(spark, folder, with_null_id: bool = True):
    """The rows as a scan of files, as the operators get them."""
    path = f"{folder}/odd.parquet"
    spark.createDataFrame(rows(with_null_id), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def empty(spark, folder):
    path = f"{folder}/empty.parquet"
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
