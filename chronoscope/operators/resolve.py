"""Joins that resolve paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.functions.values import id_name
from chronoscope.operators.settled import settled


def first_by_key(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): of each key the value of its first row in the order; combined before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_by_key(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_rows(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of equal keys the first row by ``order``; an aggregate, so it combines before the shuffle."""
    return rows.groupBy(*keys).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in rows.columns if c not in keys))


def full_path(parent: Column, name: Column) -> Column:
    """Parent and name; the name alone where the parent isn't known."""
    return F.coalesce(F.concat(parent, F.lit("\\"), name), name)


def resolve_parents(rows: DataFrame, paths: DataFrame, key: str = "parent", path: str = "parent_path", name: str = "name") -> DataFrame:
    """rows with ``path``: a left join on the parent; paths has one row a key. AQE picks the join by the sides' sizes."""
    return rows.join(paths, key, "left").withColumn("path", full_path(F.col(path), F.col(name)))


def parent_chain(nodes: DataFrame, node: str = "node", parent: str = "parent", name: str = "name") -> DataFrame:
    """(node, path, depth) by pointer doubling: each round doubles the known stretch of every node's path.

    A node whose parent is null, itself or not in the table is a root. Depths have no
    gaps, so where a round finishes no node, what is still open leads into a cycle, and such
    a node keeps its own name. A round is one join of tables that the round before wrote."""
    known = nodes.select(F.col(node).alias("_known"))
    own = nodes.join(known, nodes[parent] == known["_known"], "left").select(F.col(node).alias("node"), F.when(F.col("_known") != F.col(node), F.col("_known")).alias("up"), F.col(name).cast("string").alias("path"), F.col(name).cast("string").alias("own"), F.lit(1).alias("depth"))
    own, before = settled(own), None
    while (open_nodes := own.where("up is not null").count()) and open_nodes != before:
        above = own.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("more"))
        own = own.join(above, "up", "left").select("node", F.col("next").alias("up"), F.coalesce(F.concat_ws("\\", "head", "path"), "path").alias("path"), "own", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        own, before = settled(own), open_nodes
    open_ = F.col("up").isNotNull()
    return own.select("node", F.when(open_, F.col("own")).otherwise(F.col("path")).alias("path"), F.when(open_, 1).otherwise(F.col("depth")).alias("depth"))


def resolve_ids(rows: DataFrame, names: DataFrame, key: str, value: str, as_name: str = "name") -> DataFrame:
    """rows with the name of an id; ``ID:n`` where it isn't known, ``?`` where there is no id. names has one row a key."""
    joined = rows.join(names, key, "left")
    return joined.withColumn(as_name, F.coalesce(F.col(value), F.concat(F.lit("ID:"), F.col(key).cast("string")), F.lit("?")))


def id_map(blobs: DataFrame, key: str, blob: str, *order: str, name: str = "value") -> DataFrame:
    """(key, name) from a table of ids and binary names: of each id its last blob, by ``order``, that says a name (``values.id_name``)."""
    named = blobs.where(F.col(key).isNotNull()).withColumn(name, id_name(F.col(blob))).where(F.col(name).isNotNull())
    return last_by_key(named, key, name, *order)


def visits(urls: DataFrame, seen: DataFrame, url_key: str, visit_key: str, by: str, order: list[Column], most: int) -> DataFrame:
    """Visits with their pages, of each ``by`` only the first ``most`` in the order (a top-k report for each history file)."""
    from pyspark.sql import Window

    joined = urls.join(seen, urls[url_key] == seen[visit_key])
    return joined.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")
