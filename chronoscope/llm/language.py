"""Language identification by language-bitmask n-gram filters.

Training counts letter trigrams (with word ends) by language over all learning
documents. All of them go into one bit-sliced Bloom filter: a slot has a bit for each
language and level, a trigram sets its languages' bits in HASHES slots, and the AND
of these slots returns all languages that contain a trigram, in one lookup. Level 0
has every trigram of a language, the next ones those that make up at least a share
of its trigrams (LEVELS): the larger a corpus, the more trigrams every language has
at all, by names and quotations, but the shares stay.

A text's trigrams are looked up, hits are counted by language and level, and each
count is corrected by the filter's false-positive rate for these, which follows from
the share of the bits that are set: (hits - rate) summed over the levels, by the sum of
(1 - rate), so a level that is so full that it tells nothing has no weight. The highest
corrected share decides.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or
where nothing could be learned; equal shares go to the first language by name; rows
with the same id are treated each for itself; a text of any length counts as a whole;
a document without id counts as one with an empty id; an empty table gives an empty
result; further columns aren't read, but columns named as the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoscope.llm.shared import plain, slices, tidy

UNDECIDED = "und"
#: The least share of a language's trigrams that a trigram of each level has.
LEVELS = (0.0, 1e-5, 1e-4)
#: Slots (a power of two) and hash functions of the filter. Beyond WORDS words of 64 bits in all, the slots are halved
#: until the table is no larger, but not below LEAST_SLOTS.
SLOTS, HASHES, WORDS, LEAST_SLOTS = 1 << 20, 3, 1 << 22, 1 << 10
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

#: Characters of a text that are looked at together; a longer one is cut where no letter stands.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter; built once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def pieces(text: str) -> list[str]:
    """A long text in parts that together have the trigrams of the whole."""
    out, start = [], 0
    while len(text) - start > PIECE:
        stop = start + PIECE
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed trigrams of all texts, 21 bits a code point, and the text of each. A run of other characters is one 0; the middle is a letter."""
    lower = [x.lower() for x in texts.to_pylist()]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("".join(x + "\n" for x in lower).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(lower)), lengths + 1)
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    points, text, letter = np.where(letter, points, 0)[keep].astype(np.int64), text[keep], letter[keep]
    before = np.concatenate([[0], points[:-1]]) if len(points) else points
    after = np.concatenate([points[1:], [0]]) if len(points) else points
    return (before << 42 | points << 21 | after)[letter], text[letter]


def slots_of(grams: np.ndarray, k: int, slots: int = SLOTS) -> np.ndarray:
    """The slot of each trigram under hash function k."""
    x = (grams.astype(np.uint64) + SEEDS[k]) * SEEDS[(k + 1) % len(SEEDS)]
    x ^= x >> np.uint64(29)
    return ((x * SEEDS[k]) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """The filter: a 64-bit word a slot for every 64 bits, bit ``level * languages + language``."""

    languages: list[str]
    words: np.ndarray
    levels: int = 1

    def bit(self, i: int, words: list[np.ndarray] | np.ndarray) -> np.ndarray:
        return (words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def false_rates(self) -> np.ndarray:
        """For each bit how often a trigram that isn't in its set is found."""
        return np.array([self.bit(i, self.words).mean() ** HASHES for i in range(self.levels * len(self.languages))])

    def contained(self, grams: np.ndarray) -> list[np.ndarray]:
        """The bits of each trigram, 64 a word."""
        at = [slots_of(grams, k, self.words.shape[1]) for k in range(HASHES)]
        return [np.bitwise_and.reduce([word[x] for x in at]) for word in self.words]

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many of each text's trigrams have each bit, and how many there are."""
        grams, text = trigrams(texts)
        many = np.bincount(text, minlength=len(texts))
        found = self.contained(grams)
        having = np.flatnonzero(many)
        first = (np.cumsum(many) - many)[having]
        out = np.zeros((len(texts), self.levels * len(self.languages)))
        for i in range(out.shape[1] if len(having) else 0):
            out[having, i] = np.add.reduceat(self.bit(i, found), first)
        return out, many

    def shares(self, texts: pa.Array, rates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) shares of trigrams, corrected for false positives, and each text's number of trigrams."""
        parts = pieces(texts[0].as_py()) if len(texts) == 1 else []
        if len(parts) > 1:
            found, many = (sum(x) for x in zip(*(self.hits(pa.array([p])) for p in parts)))
        else:
            found, many = self.hits(texts)
        rates, n = self.false_rates() if rates is None else rates, len(self.languages)
        out = (found / np.maximum(many, 1)[:, None] - rates * (many > 0)[:, None]).reshape(len(texts), self.levels, n).sum(1)
        weight = (1 - rates.reshape(self.levels, n)).sum(0) if n else np.ones(0)
        return np.clip(out / np.maximum(weight, 1e-9), 0, 1), many


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table with columns lang and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                lang = part.column("lang").dictionary_encode()
                code = lang.indices.to_numpy()
                texts = plain(part.column("t"))
                for some in [pa.array([p]) for p in pieces(texts[0].as_py())] if len(texts) == 1 else [texts]:
                    grams, text = trigrams(some)
                    for i, name in enumerate(lang.dictionary.to_pylist()):
                        found, n = np.unique(grams[code[text] == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])

    return labelled.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, levels: tuple[float, ...] = LEVELS) -> LanguageFilter:
    """The filter of a table with columns lang (not null) and t. Counting is Spark's; the filled slots come to the driver, at most WORDS of them unless LEAST_SLOTS for all languages are more."""
    counts = trigram_counts(labelled).persist()
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    many, slots = max(1, -(-len(languages) * len(levels) // 64)), SLOTS
    while many * slots > WORDS and slots > LEAST_SLOTS:
        slots //= 2
    words = np.zeros((many, slots), np.uint64)
    if languages:
        order = labelled.sparkSession.createDataFrame([(x, i, totals[x]) for i, x in enumerate(languages)], "lang string, nth int, total long")
        n = len(languages)
        shared = counts.join(F.broadcast(order), "lang")  # a row for each language, which the driver has listed
        bits = F.array_compact(F.array(*(F.when(F.col("n") >= share * F.col("total"), F.col("nth") + k * n) for k, share in enumerate(levels))))
        kept = shared.select("gram", F.explode(bits).alias("bit")).select("gram", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("bits")).groupBy("word", "gram").agg(F.bit_or("bits").alias("bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = batch.column("gram").to_numpy()
                at = np.concatenate([slots_of(grams, k, slots) for k in range(HASHES)])
                word, bits = batch.column("word"), batch.column("bits")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([word] * HASHES), pa.array(at), pa.concat_arrays([bits] * HASHES)], names=["word", "slot", "bits"])

        filled = kept.mapInArrow(tidy(run), "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    counts.unpersist()
    return LanguageFilter(languages, words, len(levels))


def identify(docs: DataFrame, model: LanguageFilter, text_column: str = "text") -> DataFrame:
    """docs with lang_pred and score (the corrected share of trigrams); columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rates = model.false_rates()
        names = np.array([*model.languages, UNDECIDED], object)
        for batch in batches:
            for part in slices(batch, text_column):
                share, many = model.shares(plain(part.column(text_column)), rates)
                if model.languages:
                    best = np.where(many > 0, share.argmax(1), len(model.languages))
                    score = np.where(many > 0, share.max(1), 0.0)
                else:
                    best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_column: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves the remainder ``fold``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identified_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents' own columns with held_out, lang_pred and score: learned from the documents that aren't held out and name a language."""
    own = docs.withColumn("held_out", held_out(id_column, 4, 2))
    labelled = own.where(~F.col("held_out") & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    model = learn(labelled.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("t")))
    return identify(own, model, text_column)
