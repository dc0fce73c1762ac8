"""A quality classifier as a sparse rule ensemble, applied as Spark column expressions.

Statistics of a text (shares of characters, words and lines, all DataFrame
functions) are the inputs. A small random forest over them is grown by Spark ML;
every path from a root to a node is a rule, a conjunction of comparisons. A
logistic regression with an L1 penalty weights the rules, most get weight 0, and
the rest are compiled to one SQL expression. The forest isn't used for scoring.

Defined results: a null or empty text has statistics of 0 and gets a score like
any other; without learnable labels of both kinds the score is the smoothed share
of label 1; rows with the same id are scored each for itself, and a label counts
for each; null labels aren't learned; a document without id is never held out; a
text of any length counts as a whole; equal texts have equal scores; an empty table
gives an empty result; further columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.language import held_out
from chronoscope.llm.shared import written

#: Labelled rows to learn from; of more, about so many are drawn by a hash of the id.
MOST_TRAINING = 200_000
TREES, DEPTH, PENALTY, ROUNDS, SEED = 12, 3, 0.0005, 60, 7
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name; each is a double and never null."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(count(r"\S+"), F.lit(1.0))
    split_words, split_lines = F.split(text, r"\s+"), F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": chars / words,
        "symbols": count(r"[#$%&*<>{}=_~^\\/@+]") / chars,
        "exclamations": count("[!?]") / words,
        "bars": count(r"\|") / words,
        "capitals": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "stops": count("[.,;:]") / words,
        "words_a_line": words / (count("\n") + 1),
        "distinct_words": F.size(F.array_distinct(split_words)).cast("double") / F.size(split_words),
        "distinct_lines": F.size(F.array_distinct(split_lines)).cast("double") / F.size(split_lines),
        "same_word_again": count(r"(?<!\S)(\S++)\s++(?=\1(?!\S))") / words,
    }


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with x, the array of statistics; the text is evaluated once for each."""
    return docs.withColumn("x", F.array(*statistics(F.col(text_column)).values()))


Rule = tuple[tuple[int, str, float], ...]


def rules_of(debug: str) -> list[Rule]:
    """Every path from a root to a node, as conjunctions of (statistic, comparison, bound), from a forest's printed form.

    A bound is repeated along a path only in its tightest form; equal rules count once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            path = [] if line.strip().startswith("Tree") else path
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
        tight: dict[tuple[int, str], float] = {}
        for _, (i, sign, bound) in path:
            old = tight.get((i, sign), bound)
            tight[i, sign] = min(old, bound) if sign == "<=" else max(old, bound)
        found[tuple(sorted((i, sign, bound) for (i, sign), bound in tight.items()))] = None
    return list(found)


def condition(rule: Rule) -> str:
    return " and ".join(f"x[{i}] {sign} {bound!r}D" for i, sign, bound in rule)


class RuleEnsemble:
    """Weighted rules; ``score`` is the SQL expression of the probability of label 1."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self) -> Column:
        terms = [f"if({condition(rule)}, {weight!r}D, 0D)" for rule, weight in self.rules]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")


def learn(training: DataFrame) -> RuleEnsemble:
    """Rules and weights of a table with x (array of statistics) and y (0 or 1)."""
    training = written(training.select(array_to_vector("x").alias("features"), "x", F.col("y").cast("double").alias("y")), "training")
    many = {int(r["y"]): r["count"] for r in training.groupBy("y").count().collect()}
    ones, total = many.get(1, 0), sum(many.values())
    base = math.log((ones + 1) / (total - ones + 1))
    if not 0 < ones < total:
        return RuleEnsemble([], base)
    forest = RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(training)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleEnsemble([], base)
    fired = training.select("y", array_to_vector(F.array(*(F.expr(f"cast({condition(r)} as double)") for r in rules))).alias("features"))
    weights = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=ROUNDS, standardization=False).fit(written(fired, "rules"))
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights.coefficients.toArray()) if w], float(weights.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every document; the labels of held-out documents aren't looked at."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("held_out", held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull())
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).alias("y")).where("y is not null and doc_id is not null")
    known = known.where(~held_out("doc_id", 5, 0))
    if (many := known.count()) > MOST_TRAINING:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(many)) < MOST_TRAINING)
    seen = written(with_statistics(own).select("doc_id", "held_out", "x"), "statistics")
    model = learn(known.join(seen.select("doc_id", "x"), "doc_id"))
    return seen.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
