"""Language-model scores by Brown class-based bigrams.

Counting: every word of the learning documents is counted, over the whole corpus,
by a 64-bit hash.

Exchange clustering, in two steps. The seed: the most frequent OWN_UNITS words are units,
all others share units by their ending; unit bigrams are counted over all learning
documents (a table of at most units squared: 53 MB), units are dealt to classes by
frequency, and then, unit by unit, each moves to the class where the class bigrams'
mutual information is highest, until no unit moves or PASSES are over. Then every other
word of the vocabulary, however rare, makes its own exchange move from the class of
its ending: over all learning documents it is counted how often each class stands
before and after it, and it goes to the class where these counts raise the information
most, if that is more than naming a class takes (the logarithm of their number; a word
that occurs once or twice seldom says so much). These moves don't depend on each other,
so they are one grouped aggregation. Words that no learning document has take the class
of their ending.

A text ends with an end unit, which also stands before its first word and stays in a
class of its own.

P(word | previous) = P(class | previous class) * P(word | class), the first with
additive smoothing towards the class's share, the second with counts + 0.5 over the
words of the class and one unknown word; so every text has a finite score.

Scoring: the classes of a document's words become a string of bytes. Frequent words (at
most FREQUENT, broadcast) are looked up in the task; of other words only (document,
place, hash) rows leave it, to be joined with the whole vocabulary and put in their
places again. The class bigrams are then counted, and documents scored, from these strings.

Defined results: a null or empty text, or one without words, is the end token
alone; a very long text is one string of classes; without any learning text all counts
are 0; rows with the same id are scored each for itself; equal gains go to the first
class; a document without id counts as one with an empty id; an empty table gives an
empty result; further columns are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.language import held_out
from chronoscope.llm.shared import most_frequent, plain, slices, tidy, written
from chronoscope.llm.shingles import string_hashes

OWN_UNITS, ENDING_UNITS, CLASSES, PASSES = 2048, 512, 64, 4
FREQUENT = 1 << 17
#: In a string of classes: a word that isn't looked up in the task.
LATER = 255
#: Counts of words beside classes that a task weighs together.
WEIGHED_AT_ONCE = 1 << 14
#: Words of a task that are counted together before they leave it.
COUNT_AT_ONCE = 4 << 20
#: Weight of a class's share in the class bigrams' smoothing.
SMOOTHING = 2.0

ROW = "lm_row"


@dataclass
class Words:
    """The words of some texts: hash and ending bucket of each distinct one, the number of each word, and where each text's words begin and the last end."""

    distinct: np.ndarray
    endings: np.ndarray
    at: np.ndarray
    bounds: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.distinct[self.at]

    @property
    def buckets(self) -> np.ndarray:
        return self.endings[self.at]


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    bounds = (offsets - offsets[0]).astype(np.int64)
    keep = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not keep.all():
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        words = words.filter(pa.array(keep))
    if not len(words):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), bounds)
    coded = words.dictionary_encode()
    endings = pc.utf8_slice_codeunits(coded.dictionary, start=-3)
    return Words(string_hashes(coded.dictionary), (string_hashes(endings) % np.uint64(ENDING_UNITS)).astype(np.int32), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds)


def word_counts(learning: DataFrame) -> DataFrame:
    """(word, bucket, c) of all words of column t; the sums of a task leave it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def counted() -> pa.RecordBatch:
            hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in kept)])
            buckets = np.concatenate([np.zeros(0, np.int32), *(b for _, b in kept)])
            kept.clear()
            found, first, c = np.unique(hashes, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(buckets[first]), pa.array(c)], names=["word", "bucket", "c"])

        for batch in batches:
            for part in slices(batch, "t"):
                words = words_of(plain(part.column("t")))
                kept.append((words.hashes, words.buckets))
                held += len(words.at)
                if held >= COUNT_AT_ONCE:
                    yield counted()
                    held = 0
        yield counted()

    return learning.select("t").mapInArrow(tidy(run), "word long, bucket int, c long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Units:
    """The unit of each word: own units by sorted hash, else by ending; the last is the end of a text."""

    own: np.ndarray

    @property
    def many(self) -> int:
        return len(self.own) + ENDING_UNITS + 1

    @property
    def end(self) -> int:
        return self.many - 1

    def of(self, hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return buckets.astype(np.int64)
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, at, len(self.own) + buckets)

    def sequences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(previous unit, unit) of every token of all texts, the end of each text included."""
        units = np.insert(self.of(words.distinct, words.endings)[words.at], words.bounds[1:], self.end)
        return np.concatenate([[self.end], units[:-1]]), units


def unit_bigrams(learning: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each: a square table. At most units squared sums come to the driver."""
    shared = learning.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        total = np.zeros(units.many * units.many, np.int32)
        for batch in batches:
            for part in slices(batch, "t"):
                before, now = units.sequences(words_of(plain(part.column("t"))))
                if len(now):
                    pairs, n = np.unique(before * units.many + now, return_counts=True)
                    total[pairs] += n.astype(np.int32)
        pairs = np.flatnonzero(total)
        for i in range(0, len(pairs), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 18)]), pa.array(total[pairs[i : i + (1 << 18)]].astype(np.int64))], names=["pair", "n"])

    found = learning.select("t").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(units.many * units.many)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(units.many, units.many)


def entropy_terms(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(table: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """The class of each unit: the last unit alone in class 0, the others by the exchange algorithm."""
    many = len(table)
    weight = table.sum(0)
    order = np.argsort(-weight[:-1], kind="stable")
    free = max(1, classes - 1)
    of = np.zeros(many, np.int64)
    of[order] = 1 + np.arange(many - 1) % free
    size = free + 1
    one_hot = np.zeros((many, size))
    one_hot[np.arange(many), of] = 1
    grams = one_hot.T @ table @ one_hot
    for _ in range(passes):
        moved = 0
        for u in order:
            if not weight[u] and not table[u].any():
                continue
            a, own = of[u], table[u, u]
            after = np.bincount(of, weights=table[u], minlength=size)
            before = np.bincount(of, weights=table[:, u], minlength=size)
            after[a] -= own
            before[a] -= own
            grams[a] -= after
            grams[:, a] -= before
            grams[a, a] -= own
            rows, columns = grams.sum(1), grams.sum(0)
            # What the sum of n log n over class bigrams, less that over both margins, gains where u goes to each class.
            gain = (entropy_terms(grams + after) - entropy_terms(grams)).sum(1) + (entropy_terms(grams + before[:, None]) - entropy_terms(grams)).sum(0)
            corner = np.diag(grams)
            gain += entropy_terms(corner + after + before + own) - entropy_terms(corner + after) - entropy_terms(corner + before) + entropy_terms(corner)
            out, into = after.sum() + own, before.sum() + own
            gain -= entropy_terms(rows + out) - entropy_terms(rows) + entropy_terms(columns + into) - entropy_terms(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[u] = b
            grams[b] += after
            grams[:, b] += before
            grams[b, b] += own
        if not moved:
            break
    return of


@dataclass
class Seed:
    """The units' classes, and how often a class follows another."""

    units: Units
    classes: np.ndarray
    grams: np.ndarray

    @property
    def endings(self) -> np.ndarray:
        """The class of each ending."""
        return self.classes[len(self.units.own) : -1]


def seed(learning: DataFrame, vocabulary: DataFrame) -> Seed:
    most = most_frequent(vocabulary, "c", FREQUENT).select("word", "c").orderBy(F.desc("c"), "word").limit(OWN_UNITS).toArrow()
    units = Units(np.sort(most.column("word").to_numpy().view(np.uint64)))
    table = unit_bigrams(learning, units)
    classes = exchange(table, CLASSES, PASSES)
    size = int(classes.max()) + 1
    hot = np.zeros((units.many, size))
    hot[np.arange(units.many), classes] = 1
    return Seed(units, classes, hot.T @ table @ hot)


def neighbours(learning: DataFrame, model: Seed) -> DataFrame:
    """(word, sides, ns) of every word that isn't an own unit: how often which class comes after it (side = class) or before it (size + class)."""
    shared = learning.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = len(m.grams)
        for batch in batches:
            for part in slices(batch, "t"):
                words = words_of(plain(part.column("t")))
                before, now = m.units.sequences(words)
                own = np.insert(words.at, words.bounds[1:], -1)
                open_ = (own >= 0) & (now >= len(m.units.own))
                after, before = m.classes[np.append(now[1:], m.units.end)][open_], m.classes[before][open_]
                own = own[open_] * 2 * size
                codes, n = np.unique(np.concatenate([own + after, own + size + before]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.distinct[codes // (2 * size)].view(np.int64)), pa.array((codes % (2 * size)).astype(np.int16)), pa.array(n)], names=["word", "side", "n"])

    counts = learning.select("t").mapInArrow(tidy(run), "word long, side short, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))
    # At most two sides of each class: the lists of a word are short, however often it occurs.
    return counts.groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("x")).select("word", F.col("x.side").alias("sides"), F.col("x.n").alias("ns"))


def best_classes(sides: np.ndarray, ns: np.ndarray, ends: np.ndarray, home: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The class where each word's counts raise the information of the class bigrams most, or its home, in which they are now, if that doesn't gain enough.

    Word i has the counts from ends[i - 1] on, at least one. Class 0 is the end's."""
    size = len(grams)
    tables = np.concatenate([grams.T, grams])  # row: what stands beside, column: the word's class
    totals = np.stack([grams.sum(1), grams.sum(0)])
    first, many = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    x, now, at_home = ns.astype(float)[:, None], tables[sides], np.arange(len(ends))
    gain = np.add.reduceat(entropy_terms(now + x) - entropy_terms(now), first, axis=0)
    mine = now[np.arange(len(sides)), np.repeat(home, many)]
    stay = np.add.reduceat(entropy_terms(mine) - entropy_terms(mine - ns), first)
    for k in (0, 1):
        all_ = np.add.reduceat(np.where(sides // size == k, ns, 0).astype(float), first)
        gain -= entropy_terms(totals[k] + all_[:, None]) - entropy_terms(totals[k])
        stay -= entropy_terms(totals[k][home]) - entropy_terms(totals[k][home] - all_)
    gain[:, 0] = -np.inf
    gain[at_home, home] = stay
    best = gain.argmax(1)
    return np.where(gain[at_home, best] - stay > np.log(size), best, home)


def word_classes(learning: DataFrame, vocabulary: DataFrame, model: Seed) -> DataFrame:
    """(word, c, cls) of the whole vocabulary."""
    shared = learning.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            units = m.units.of(batch.column("word").to_numpy().view(np.uint64), batch.column("bucket").to_numpy())
            cls = m.classes[units]
            open_ = np.flatnonzero((units >= len(m.units.own)) & batch.column("sides").is_valid().to_numpy(zero_copy_only=False))
            sides, ns = (batch.column(k).take(pa.array(open_)) for k in ("sides", "ns"))
            ends = sides.offsets.to_numpy().astype(np.int64) - sides.offsets[0].as_py()
            sides, ns = sides.flatten().to_numpy().astype(np.int64), ns.flatten().to_numpy()
            start = 0
            while start < len(open_):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WEIGHED_AT_ONCE, side="right")) - 1)
                cut = slice(int(ends[start]), int(ends[stop]))
                cls[open_[start:stop]] = best_classes(sides[cut], ns[cut], ends[start + 1 : stop + 1] - ends[start], cls[open_[start:stop]], m.grams)
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(cls.astype(np.int32))], names=["word", "c", "cls"])

    return written(vocabulary.join(neighbours(learning, model), "word", "left").select("word", "bucket", "c", "sides", "ns").mapInArrow(tidy(run), "word long, c long, cls int"), "word-classes")


def by_ending(model: Seed) -> Column:
    return F.get(F.lit([int(k) for k in model.endings]), F.col("bucket"))


SEQUENCES = "lm_row long, doc_id long, held_out boolean, n_tokens long, known long, counted double, classes binary, later array<long>, buckets array<int>"


def class_sequences(rows: DataFrame, classes: DataFrame, model: Seed, end_count: int) -> DataFrame:
    """lm_row, doc_id, held_out, n_tokens, known, counted (the sum of log10(count + 0.5)) and classes (a byte for each token) of every document."""
    most = most_frequent(classes, "c", FREQUENT).toArrow().sort_by([("word", "ascending")])
    hashes, counts, own = (most.column(x).to_numpy() for x in ("word", "c", "cls"))
    order = np.argsort(hashes.view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast((hashes.view(np.uint64)[order], counts[order], own[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, own = shared.value
        logs, own = np.append(np.log10(counts + 0.5), 0.0), np.append(own, LATER).astype(np.uint8)
        for batch in batches:
            for part in slices(batch, "t"):
                words = words_of(plain(part.column("t")))
                at = np.minimum(np.searchsorted(frequent, words.distinct), max(0, len(frequent) - 1))
                at = np.where(frequent[at] == words.distinct, at, len(frequent)) if len(frequent) else np.zeros(len(words.distinct), np.int64)
                at = at[words.at]
                text = np.repeat(np.arange(part.num_rows), np.diff(words.bounds))
                now = at < len(frequent)
                counted = np.bincount(text, weights=logs[at], minlength=part.num_rows) + np.log10(end_count + 0.5)
                known = np.bincount(text[now], minlength=part.num_rows) + (end_count > 0)
                ends = words.bounds + np.arange(len(words.bounds))
                found = np.insert(own[at], words.bounds[1:], 0)
                later = np.flatnonzero(~now)
                cuts = pa.array(np.searchsorted(later, words.bounds).astype(np.int32))
                columns = [pa.array(np.diff(ends)), pa.array(known.astype(np.int64)), pa.array(counted), pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found.tobytes())])]
                columns += [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (words.hashes[later].view(np.int64), words.buckets[later])]
                yield pa.RecordBatch.from_arrays([part.column(ROW), part.column("doc_id"), part.column("held_out"), *columns], names=[ROW, "doc_id", "held_out", "n_tokens", "known", "counted", "classes", "later", "buckets"])

    parts = written(rows.select(ROW, "doc_id", "held_out", "t").mapInArrow(tidy(run), SEQUENCES), "sequences", compression="zstd")
    rare = parts.select(ROW, F.posexplode(F.arrays_zip("later", "buckets")).alias("nth", "x")).select(ROW, "nth", F.col("x.later").alias("word"), F.col("x.buckets").alias("bucket"))
    found = rare.join(classes, "word", "left").select(ROW, "nth", F.coalesce("cls", by_ending(model)).cast("byte").alias("cls"), F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("log"), F.col("c").isNotNull().cast("int").alias("had"))
    sums = found.groupBy(ROW).agg(F.sum("log").alias("more"), F.sum("had").alias("more_known"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "cls"))), lambda x: x["cls"]).alias("fill"))
    joined = parts.drop("later", "buckets").join(sums, ROW, "left")
    joined = joined.select(ROW, "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("known"), (F.col("counted") + F.coalesce("more", F.lit(0.0))).alias("counted"), "classes", "fill")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, bounds = bytes_of(batch.column("classes"))
            classes = classes.copy()
            classes[classes == LATER] = batch.column("fill").flatten().to_numpy(zero_copy_only=False).view(np.uint8)
            whole = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(classes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], whole], names=batch.schema.names[:7])

    return written(joined.mapInArrow(tidy(fill), SEQUENCES[: SEQUENCES.index(", later")]), "classes", compression="zstd")


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings without nulls, and where each begins and the last ends."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps_of(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class before each token; the end's before the first of each text."""
    before = np.concatenate([np.zeros(1, np.uint8), classes[:-1]])
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    return before


def class_bigrams(sequences: DataFrame, size: int) -> np.ndarray:
    """How often each class follows each, over all documents of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            classes, bounds = bytes_of(batch.column("classes"))
            total += np.bincount(steps_of(classes, bounds).astype(np.int64) * size + classes, minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    found = sequences.select("classes").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


@dataclass
class BrownModel:
    """log10 probabilities of a class after a class, and what log10(count + 0.5) of a word loses in its class."""

    steps: np.ndarray
    emission: np.ndarray
    tokens: int
    words: int


def fit(sequences: DataFrame, classes: DataFrame, size: int, end_count: int) -> BrownModel:
    """The model of the learning documents' class sequences and the vocabulary's classes."""
    grams = class_bigrams(sequences, size)
    share = (grams.sum(0) + 0.5) / (grams.sum() + 0.5 * size)
    steps = np.log10((grams + SMOOTHING * share) / (grams.sum(1, keepdims=True) + SMOOTHING))
    totals, kinds = np.zeros(size), np.zeros(size)
    totals[0], kinds[0] = end_count, 1
    for r in classes.groupBy("cls").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).collect():
        totals[r["cls"]] += r["total"]
        kinds[r["cls"]] += r["kinds"]
    return BrownModel(steps, np.log10(totals + 0.5 * (kinds + 1)), int(totals.sum()), int(kinds.sum()) - (0 if end_count else 1))


def scored(sequences: DataFrame, model: BrownModel) -> DataFrame:
    """doc_id, held_out, n_tokens, known, counted, and classed: what the classes add to the score."""
    shared = sequences.sparkSession.sparkContext.broadcast(model.steps - model.emission)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            classes, bounds = bytes_of(batch.column("classes"))
            sums = np.concatenate([[0.0], np.cumsum(table[steps_of(classes, bounds), classes])])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:6], pa.array(np.diff(sums[bounds]))], names=[*batch.schema.names[1:6], "classed"])

    return sequences.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, known long, counted double, classed double")


def trained(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, Seed, BrownModel]:
    """The documents' class sequences, the vocabulary's classes, the seed and the model."""
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("t"), held_out(id_column, 5, 1).alias("held_out"))
    learning = rows.where(~F.col("held_out"))
    vocabulary = written(word_counts(learning), "vocabulary")
    end_count = learning.count()
    first = seed(learning, vocabulary)
    classes = word_classes(learning, vocabulary, first)
    sequences = class_sequences(rows, classes, first, end_count)
    return sequences, classes, first, fit(sequences.where(~F.col("held_out")), classes, len(first.grams), end_count)


def brown_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (class bigrams) of every document."""
    sequences, _, _, model = trained(docs, id_column, text_column)
    unigram = float(np.log10(model.tokens + 0.5 * (model.words + 1)))
    return scored(sequences, model).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(unigram)).alias("base_score"),
        (F.col("counted") + F.col("classed")).alias("score"),
    )
