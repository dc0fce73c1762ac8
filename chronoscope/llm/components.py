"""Connected components of an edge table by Spark joins; nothing is gathered on the driver but whether a table is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.shared import dropped, written


def rooted(parents: DataFrame) -> DataFrame:
    """(v, p) with every p followed to the end: each round makes the steps that are left at most a quarter."""
    while True:
        hop = parents.select(F.col("v").alias("p"), F.col("p").alias("next"))
        far = parents.join(hop, "p").select("v", F.col("p").alias("old"), F.col("next").alias("p"))
        far = written(far.join(hop, "p").select("v", "old", F.col("next").alias("p")), "parents")
        dropped(parents)
        parents = far.select("v", "p")
        if far.where("p <> old").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every end of an edge (columns a and b): comp is the smallest v of its component.

    Each round a vertex joins its smallest neighbour, if that is smaller than itself, and what
    joined one root becomes one vertex. A vertex that stays has only larger neighbours, which all
    joined something, so a round leaves at most half of the vertices that have edges, and
    rounds grow with the logarithm of their number, whatever a component's form or labels. The edges
    that are left shrink likewise. At the end labels are passed down from the last round to the first. Sums
    over a hot vertex are combined before the shuffle."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    rounds = []
    while not rounds or not both.isEmpty():
        parents = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), "parents")
        rounds.append(rooted(parents))
        a, b = (rounds[-1].select(F.col("v").alias(c), F.col("p").alias(f"root_{c}")) for c in "ab")
        joined = both.where("a < b").join(a, "a").join(b, "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        before, both = both, written(joined.union(joined.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        dropped(before)

    def passed_down(later: DataFrame, earlier: DataFrame) -> DataFrame:
        return earlier.join(later.select(F.col("v").alias("p"), "comp"), "p", "left").select("v", F.coalesce("comp", "p").alias("comp"))

    last = rounds.pop().select("v", F.col("p").alias("comp"))
    return written(reduce(passed_down, reversed(rounds), last), "labels")
