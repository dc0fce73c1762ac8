"""What filters do to each other: every order of them, and what each removes at each step.

Documents become few narrow rows first: for each part, what the filters say of a
document and the labels it has, with the number of documents alike. Then the trie of
all orders is walked depth first. A node is the set of filters applied so far; its
survivors are a persisted DataFrame, the parent's less what the last filter fails. Orders
that share a set share its node, so n filters need 2^n nodes instead of n! paths. At each
node one aggregation counts, for every filter still to come, what that filter removes
from these survivors; the counts go to a table in the shared folder. At most as many
nodes as there are filters are persisted at a time; if an executor is lost its rows are made
again from the written table of narrow rows.

The result is looked up: each order's steps are edges of the trie.

Defined results: a null text is empty; a null source is the part ''; a document whose id
has no label is neither good nor toxic, and of several labels of an id one that says so is
enough; a null id counts as larger than every other; repeated rows count each, and an id
isn't smaller than itself; an empty table has no parts, so no rows; columns of any other name
aren't read. Texts of any length are judged whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.shared import scratch_path, written

#: White space between words.
BLANKS = r"\x20\x09-\x0D"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text fails a filter, by letter; ``words`` are its words. The filter of repeated texts isn't among them: see ``judged``."""
    size = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": size < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * size, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame, repeated: str = "E") -> tuple[DataFrame, str]:
    """(part, fails, good, toxic, documents), and the filters' letters: for each part and label the number of documents that fail exactly the filters in the bits of ``fails``.

    A text is known by its length and SHA-256. Of equal texts all but the rows of the smallest id fail ``repeated``;
    which these are follows from the smallest id of each part and label, so equal texts never meet in one task: they are
    added up before they are dealt."""
    words = F.regexp_extract_all("t", F.lit(f"[^{BLANKS}]+"), F.lit(0))
    read = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    tests = failures(F.col("t"), F.col("w"))
    letters = "".join(tests) + repeated
    bits = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())), F.lit(0))
    narrow = read.withColumn("w", words).select("d", "part", F.struct(F.octet_length("t").alias("size"), F.sha2("t", 256).alias("sha")).alias("same"), bits.alias("fails"))
    alike = narrow.groupBy("d", "part", "same", "fails").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    labelled = alike.join(marks, "d", "left").select("d", "part", "same", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    key = F.struct(F.col("d").isNull().alias("last"), F.col("d").alias("d"), F.col("n").alias("n"))
    groups = labelled.groupBy("same", "fails", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(key).alias("first"))
    # Rows of one text: one for each part and label at most. The smallest id may be in several of them.
    groups = written(groups, "texts")
    least = groups.groupBy("same").agg(F.min(F.struct("first.last", "first.d")).alias("least"))
    own = groups.join(least, "same").withColumn("keep", F.when(F.struct("first.last", "first.d") == F.col("least"), F.col("first.n")).otherwise(0))
    own = own.withColumn("keep", F.when(F.col("least.last"), F.col("n")).otherwise(F.col("keep")))  # texts without any id: none is smaller
    kinds = F.explode(F.array(F.struct(F.col("fails"), F.col("keep").alias("documents")), F.struct(F.col("fails").bitwiseOR(F.lit(1 << len(tests))).alias("fails"), (F.col("n") - F.col("keep")).alias("documents"))))
    counted = own.select("part", "good", "toxic", kinds.alias("kind")).where("kind.documents > 0")
    return counted.groupBy("part", F.col("kind.fails").alias("fails"), "good", "toxic").agg(F.sum("kind.documents").alias("documents")), letters


def trie_edges(rows: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(part, applied, filter, kept, removed, good_lost, toxic_lost): for every set of filters applied, as bits, and every other filter what that removes of the survivors, by part.

    A part without survivors has no row."""
    folder, seen, full = scratch_path(rows.sparkSession, "edges"), set(), (1 << len(letters)) - 1

    def fails(i: int) -> Column:
        return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0

    def counts(i: int) -> Column:
        def n(test: Column) -> Column:
            return F.coalesce(F.sum(F.when(test, F.col("documents"))), F.lit(0))

        return F.struct(F.lit(letters[i]).alias("filter"), n(~fails(i)).alias("kept"), n(fails(i)).alias("removed"), n(fails(i) & F.col("good")).alias("good_lost"), n(fails(i) & F.col("toxic")).alias("toxic_lost"))

    def visit(applied: int, survivors: DataFrame) -> None:
        seen.add(applied)
        open_ = [i for i in range(len(letters)) if not applied >> i & 1]
        survivors = survivors.persist()
        try:
            edges = survivors.groupBy("part").agg(F.array(*map(counts, open_)).alias("edges"))
            edges.select("part", F.lit(applied).alias("applied"), F.inline("edges")).write.mode("append").parquet(folder)
            for i in open_:
                further = applied | 1 << i
                if further != full and further not in seen:
                    visit(further, survivors.where(~fails(i)))
        finally:
            survivors.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema("part string, applied int, filter string, kept long, removed long, good_lost long, toxic_lost long").parquet(folder)


def order_steps(letters: Sequence[str]) -> list[tuple[str, int, int, str]]:
    """(order, step, filters applied before as bits, the step's filter) of every order of the filters."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    return [("".join(order), k + 1, sum(bit[x] for x in order[:k]), order[k]) for order in itertools.permutations(letters) for k in range(len(order))]


def audit(rows: DataFrame, letters: Sequence[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for every part, order and step; zeros included.

    rows: (part, fails, good, toxic, documents). Orders grow as the factorial of the filters: some eight are the most that make sense."""
    rows = written(rows, "judged")
    edges = trie_edges(rows, letters)
    n = len(letters)
    orders_through = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), (F.bit_count("applied") + 1).cast("int"))
    others = F.lit((1 << n) - 1) - F.element_at(F.create_map(*(F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i))), F.col("filter"))
    of_filter = edges.groupBy("part", "filter").agg(
        F.coalesce(F.sum(F.when(F.col("applied") == 0, F.col("removed"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("applied") == others, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders_through).alias("shapley"),
    )
    steps = ",".join(f"named_struct('filter_order','{o}','step',{k},'applied',{a},'filter','{f}')" for o, k, a, f in order_steps(letters))
    wanted = rows.select("part").distinct().selectExpr("part", f"inline(array({steps}))")
    found = wanted.join(edges, ["part", "applied", "filter"], "left").join(of_filter, ["part", "filter"])
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")}
    return found.select("part", "filter_order", "step", zero["kept"], zero["removed"], (F.col("failing") - zero["removed"]).cast("long").alias("redundant"), F.col("unique_fails").cast("long").alias("unique_fails"), zero["good_lost"], zero["toxic_lost"], F.col("shapley").cast("long").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters of ``judged`` on documents."""
    return audit(*judged(docs, labels))


#: The same rows: each document's failures, then every order's steps over the counts of equal ones.
ORACLE_SQL = r"""
with text_rows as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), smallest as (
  select t, min(doc_id) as least from text_rows group by t
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), judged as (
  select r.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
    (len(w) < 50)::int as a, (100 * len(list_distinct(w)) < 65 * len(w))::int as b,
    (100 * (length(r.t) - length(regexp_replace(r.t, '[A-Z]', '', 'g'))) > 5 * length(r.t))::int as c,
    regexp_matches(r.t, '[#$%&*|]')::int as d, coalesce(r.doc_id > s.least, s.least is not null)::int as e
  from text_rows r join smallest s on r.t = s.t left join marks m on r.doc_id = m.doc_id
), alike as (
  select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, a + b + c + d + e as many, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where p.x <> q.x and p.x <> r.x and p.x <> s.x and p.x <> t.x and q.x <> r.x and q.x <> s.x and q.x <> t.x and r.x <> s.x and r.x <> t.x and s.x <> t.x
), steps as (
  select filter_order, k::int as step, substr(filter_order, k, 1) as x, string_split(substr(filter_order, 1, k - 1), '') as before from orders, range(1, 6) as g(k)
), counted as (
  select part, filter_order, step, x,
    sum(case when reached and not failing then n else 0 end) as kept, sum(case when reached and failing then n else 0 end) as removed,
    sum(case when failing and not reached then n else 0 end) as redundant, sum(case when failing and many = 1 then n else 0 end) as unique_fails,
    sum(case when reached and failing then good else 0 end) as good_lost, sum(case when reached and failing then toxic else 0 end) as toxic_lost
  from (select a.*, s.*, fails[x] = 1 as failing, step = 1 or len(list_filter(before, lambda y: fails[y] = 1)) = 0 as reached from alike a, steps s) group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from counted
"""
