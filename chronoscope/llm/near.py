"""Documents with similar shingle sets: an exact Jaccard join by grouped prefixes.

1. Texts with the same set of word shingles are one class.
2. In a global order of shingles, two sets of Jaccard similarity t or more share one
   of the first n - ceil(t n) + 1 shingles of each (the prefix). Shingles that
   repeat across the corpus come last in the order, so that prefixes have few
   of them; any order is right, this only decides how long lists get.
3. Classes with the same prefix and size are one group; groups, not classes, go
   into the lists of a prefix shingle. A list is cut by size bands, so that only
   groups of similar sizes meet, and pairs of groups with too few common
   prefix shingles for the threshold are dropped. What is left is expanded to members.
4. Members are compared by parity sketches first: a bit for about each shingle, set
   where an odd number of the set's shingles fall on it. Two sets differ in at least
   as many shingles as their sketches do in bits, so no link is lost; texts that share
   passages but aren't similar end here. The rest is verified on whole sets.
5. Members of one group share the prefix, so in what remains of them, too, linked ones share
   one of the first shingles: they meet in lists of these, not each with each.

``near_duplicates`` wants components, not all links. So groups are first
compared with one leader of their list and size band, links so found are
contracted to components, and only then are groups of different components in
a list compared, members of the list's main component with the others alone.
No link between different components is lost, and no pairs within a component
are made. ``similar_classes`` gives every link between classes.

Shingles are 64-bit hashes and sets are told apart by 128-bit digests of them.

Defined results: a null or empty text, or one without words, has no shingles and
is its own component; fewer words than a shingle has are one shingle; repeated
rows link; a text of any length is one set; a null id is never the smallest id, and a
component without any id has a null one; an empty table gives an empty result; further
columns aren't read (``without_near_duplicates`` returns them, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoscope.llm.components import components
from chronoscope.llm.shared import dropped, in_file_order, plain, quoted, slices, tidy, unused, written
from chronoscope.llm.shingles import shingle_sets

#: Defaults: words of a shingle and the least similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: A shingle in so many classes comes late in the order, and so do those that share its bit of COMMON_BITS (2 ** 27: 16 MB are broadcast).
COMMON, COMMON_BITS = 32, 27
#: Shingles of a task that are counted together; only those that repeat among them are passed on.
COUNT_AT_ONCE = 4 << 20

ROW = "near_row"
FOUND = "kind string, near_row long, doc_id long, n long, cls binary, token long, seen long"
FOUND_NAMES = ["kind", ROW, "doc_id", "n", "cls", "token", "seen"]


def rows_of(docs: DataFrame, id_column: str, text_column: str, row: Column) -> DataFrame:
    return docs.select(row.alias(ROW), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("t"))


def set_digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def classes_and_repeats(rows: DataFrame, width: int) -> DataFrame:
    """Rows of FOUND: kind ``doc`` with each document's class and set size, kind ``token`` with shingles that repeat among a task's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        known: set[bytes] = set()

        def repeats() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            kept.clear()
            known.clear()
            tokens, seen = tokens[seen > 1], seen[seen > 1]
            none = [pa.nulls(len(tokens), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(["token"] * len(tokens), pa.string()), *none, pa.array(signed(tokens)), pa.array(seen)], names=FOUND_NAMES)

        held = 0
        for batch in batches:
            for part in slices(batch, "t"):
                tokens, bounds = shingle_sets(plain(part.column("t")), width)
                sizes = np.diff(bounds)
                digests = [set_digest(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                for i, digest in enumerate(digests):
                    if digest not in known:
                        known.add(digest)
                        kept.append(tokens[bounds[i] : bounds[i + 1]])
                        held += int(sizes[i])
                many = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * many, pa.string()), part.column(ROW), part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64())], names=FOUND_NAMES)
                if held >= COUNT_AT_ONCE:
                    yield repeats()
                    held = 0
        yield repeats()

    return rows.mapInArrow(tidy(run), FOUND)


def common_tokens(found: DataFrame) -> np.ndarray:
    """A bit for each value of a shingle's first COMMON_BITS bits: whether it comes late in the order. Its size is fixed, however many are common."""
    counted = found.where("kind = 'token'").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= COMMON)
    place = F.shiftrightunsigned("token", 64 - COMMON_BITS)
    words = counted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - COMMON_BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(max(1, 1 << COMMON_BITS - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def is_common(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    place = tokens >> np.uint64(64 - COMMON_BITS)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """A power of two of 64-bit words, with at least one bit a shingle: whether the number of shingles on it is odd."""
    words = 1 << max(0, (len(tokens) - 1) // 64).bit_length()
    at = (tokens & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(bool), bitorder="little").view(np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def prefixes(rows: DataFrame, width: int, percent: int, common: np.ndarray, second: bool = False) -> DataFrame:
    """(cls, n, rare, gid, prefix, sketch) of each class: set size, shingles that aren't common, 128 bits that stand for n and the prefix, the first shingles in the order, and the parity sketch.

    ``second`` gives (cls, prefix) alone, with the first of those after the prefix, of which linked sets of one size and prefix share one."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                tokens, bounds = shingle_sets(plain(part.column("t")), width)
                late = is_common(table, tokens)
                out: dict[bytes, tuple] = {}
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = b - a
                    if not n or (digest := set_digest(tokens[a:b])) in out:
                        continue
                    many = prefix_length(n, percent)
                    start, stop = (many, many + n + 1 - -(-2 * n * percent // (100 + percent))) if second else (0, many)
                    first = tokens[a:b][~late[a:b]]
                    rare = len(first)
                    if rare < stop:
                        first = np.concatenate([first, tokens[a:b][late[a:b]][: stop - rare]])
                    first = first[start:stop]
                    if second and stop - start > n - many:  # the prefix alone is enough for a link
                        first = np.zeros(1, np.uint64)
                    out[digest] = (n, rare, hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), first, None if second else parity_sketch(tokens[a:b]))
                cls, lists = pa.array(out.keys(), pa.binary()), lists_of([x[3] for x in out.values()])
                if second:
                    yield pa.RecordBatch.from_arrays([cls, lists], names=["cls", "prefix"])
                    continue
                yield pa.RecordBatch.from_arrays([cls, *(pa.array([x[k] for x in out.values()], pa.int64()) for k in (0, 1)), pa.array([x[2] for x in out.values()], pa.binary()), lists, lists_of([x[4] for x in out.values()])], names=["cls", "n", "rare", "gid", "prefix", "sketch"])

    return rows.select("t").mapInArrow(tidy(run), "cls binary, prefix array<long>" if second else "cls binary, n long, rare long, gid binary, prefix array<long>, sketch array<long>")


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """(cls, tokens) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                tokens, bounds = shingle_sets(plain(part.column("t")), width)
                digests = [set_digest(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(tokens)))], names=["cls", "tokens"])

    return rows.mapInArrow(tidy(run), "cls binary, tokens array<long>")


def overlap_needed(n: str, m: str, percent: int) -> str:
    """SQL for the fewest common shingles of two linked sets of n and m."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def prefix_overlap_needed(n: str, m: str, percent: int) -> str:
    """SQL for the fewest common prefix shingles: what the rest of the sets can't make up for. The rest of a set of n has ceil(t n) - 1."""
    rest = [f"(({percent} * {x} + 99) div 100 - 1)" for x in (n, m)]
    return f"greatest(1, {overlap_needed(n, m, percent)} - greatest({', '.join(rest)}))"


def sketches_agree(percent: int) -> str:
    """SQL for whether sets of n and m shingles with sketches x and y can be linked; the longer sketch is folded to the length of the other."""
    def apart(long: str, short: str) -> str:
        folded = f"if(size({long}) = size({short}), {long}, zip_with(slice({long}, 1, size({short})), slice({long}, size({short}) + 1, size({short})), (p, q) -> p ^ q))"
        return f"aggregate(zip_with({folded}, {short}, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)"

    most = f"n + m - 2 * {overlap_needed('n', 'm', percent)}"
    return f"case when greatest(size(x), size(y)) > 2 * least(size(x), size(y)) then true when size(x) >= size(y) then {apart('x', 'y')} <= {most} else {apart('y', 'x')} <= {most} end"


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of classes) that their sketches leave. sketches: cls, n, sketch."""
    first, second = (sketches.select(F.col("cls").alias(k), F.col("n").alias(n), F.col("sketch").alias(x)) for k, n, x in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(first, "a").join(second, "b").where(sketches_agree(percent)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b of classes) whose whole sets are similar enough. Only the texts of classes in a pair are read again and moved."""
    pairs = written(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = written(whole_sets(rows_of_classes(rows, classes, wanted), width), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"))
    links = written(sized.where(f"common * 100 >= {percent} * (n + m - common)").select("a", "b"), "links")
    dropped(pairs, sets)
    return links


def rows_of_classes(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row of the table for each class in ``wanted`` (cls)."""
    # A shuffle join at every size: what is wanted grows with the input, so it is never broadcast.
    wanted = classes.join(wanted, "cls", "left_semi").select(F.col("row").alias(ROW))
    return rows.join(wanted.hint("merge"), ROW, "left_semi")


def band(n: str, percent: int) -> Column:
    """The size band of n: sizes of linked sets lie in the same band or in the next one."""
    return F.floor(F.log(100.000001 / percent, F.col(n))) if percent < 100 else F.col(n)


def near_bands(n: str, percent: int) -> Column:
    return F.explode(F.array(*(band(n, percent) + k for k in ((-1, 0, 1) if percent < 100 else (0,)))))


def group_pairs(one: DataFrame, other: DataFrame, percent: int, which: str) -> DataFrame:
    """(g, h) of groups whose prefixes have enough in common. one and other: rows of lists; ``which`` says in SQL which of them may meet."""
    one = one.select("token", near_bands("n", percent).alias("band"), F.col("gid").alias("g"), F.col("n").alias("m"), F.col("pos").alias("g_pos"), F.col("commons").alias("g_commons"), F.col("low").alias("g_low"), F.col("high").alias("g_high"))
    needed = overlap_needed("n", "m", percent)
    similar = f"least(n, m) * 100 >= {percent} * greatest(n, m)"
    # Linked sets have a shingle in common among the first n - needed + 1 of one and m - needed + 1 of the other. In the
    # lists of common shingles only such places meet; the other lists give all, so that they can be counted.
    near = f"(not late or (pos <= n - {needed} and g_pos <= m - {needed}))"
    met = one.join(other.withColumn("band", band("n", percent)), ["token", "band"]).where(f"({which}) and {similar} and {near}")
    met = met.select(F.least("g", "gid").alias("g"), F.greatest("g", "gid").alias("h"), "n", "m", "late", F.least("commons", "g_commons").alias("commons"))
    counted = met.groupBy("g", "h").agg(F.count_if(~F.col("late")).alias("seen"), F.first("commons").alias("commons"), F.first("n").alias("n"), F.first("m").alias("m"))
    return counted.where(f"seen + commons >= {prefix_overlap_needed('n', 'm', percent)}").select("g", "h")


def pairs_within(members: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """(a, b) of members (gid, cls, comp) of one group and different components that share one of the first shingles after the prefix."""
    after = prefixes(rows_of_classes(rows, classes, members.select("cls").distinct()), width, percent, common, second=True)
    lists = written(members.join(after.select("cls", F.explode("prefix").alias("token")), "cls"), "member-lists")
    left, right = (lists.select("gid", "token", F.col("cls").alias(k), F.col("comp").alias(f"{k}_comp")) for k in ("a", "b"))
    return left.join(right, ["gid", "token"]).where("a < b and a_comp <> b_comp").select("a", "b").distinct()


class PrefixLists:
    """The tables of the grouped prefix join: classes, members, groups and the lists of prefix shingles."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, width: int, percent: int, row: Column | None):
        if row is None:
            row = F.col(unused(docs, ROW))
            docs = in_file_order(docs, unused(docs, ROW))
        self.width, self.percent = width, percent
        self.rows = rows_of(docs, id_column, text_column, row)
        found = written(classes_and_repeats(self.rows, width), "classes", compression="zstd")
        self.members = found.where("kind = 'doc'").select(ROW, "doc_id", "n", "cls")
        self.classes = written(self.members.where("n > 0").groupBy("cls").agg(F.min(ROW).alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("class_size")), "class-list")
        self.common = common_tokens(found)
        grouped = prefixes(self.rows, width, percent, self.common).groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "rare", "gid", "prefix", "sketch")))
        grouped = written(grouped, "prefixes", compression="zstd")
        self.sketches = grouped.select("cls", "n", "sketch")
        self.in_group = grouped.select("gid", "cls")
        # Groups of one prefix and size differ in nothing that is used before members are verified but their common shingles.
        groups = grouped.groupBy("gid").agg(F.first("n").alias("n"), F.min("rare").alias("rare"), F.first("prefix").alias("prefix"), F.min("cls").alias("head"))
        self.groups = groups.withColumn("commons", F.size("prefix") - F.least("rare", F.size("prefix")))
        listed = self.groups.select("gid", "n", "rare", "commons", "head", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
        listed = listed.select("gid", "n", "rare", "commons", "head", "pos", "token", F.expr("pos >= p - commons").alias("late"))
        shared = listed.groupBy("token").agg(F.count("*").alias("long")).where("long > 1").select("token")
        self.lists = written(listed.join(shared, "token"), "lists", compression="zstd")

    def linked(self, pairs: DataFrame, sketched_first: bool) -> DataFrame:
        pairs = sketched(pairs, self.sketches, self.percent) if sketched_first else pairs
        return verified(pairs, self.rows, self.classes, self.width, self.percent)


def similar_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) of every two classes with similar sets, a before b; and each document's class: near_row, doc_id, n_shingles, cls.

    Documents of one class are linked with each other and with all of a linked class."""
    found = PrefixLists(docs, id_column, text_column, width, percent, None)
    lists = found.lists.withColumns({"low": F.lit(None), "high": F.lit(None)})
    members = found.in_group.select("gid", "cls", F.col("cls").alias("comp"))
    of_group = members.select("gid", "cls")
    across = group_pairs(lists, lists, percent, "g < gid").join(of_group.toDF("g", "a"), "g").join(of_group.toDF("h", "b"), "h").select("a", "b")
    several = members.groupBy("gid").count().where("count > 1").select("gid")
    within = pairs_within(written(members.join(several, "gid", "left_semi"), "several"), found.rows, found.classes, width, percent, found.common)
    links = found.linked(across.union(within), True)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), found.members.withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT, row: Column | None = None) -> DataFrame:
    """A row for each document: near_row, doc_id, n_shingles, component_id (the smallest id reachable by links), class_size (documents with the same set).

    near_row is ``row``, a number that each row has for itself, by default its place in the order of the files."""
    found = PrefixLists(docs, id_column, text_column, width, percent, row)
    members, classes, groups, lists, in_group = found.members, found.classes, found.groups, found.lists, found.in_group

    # Leaders: of each list and size band the group with the fewest shingles that aren't common (the text that the
    # others vary), and of a group its first class. That a pair is left out here costs nothing but time.
    of_band = band("n", percent).alias("band")
    leaders = lists.groupBy("token", of_band).agg(F.min(F.struct("rare", "gid", "n", "head")).alias("first")).select("token", "band", F.col("first.gid").alias("lead"), F.col("first.n").alias("lead_n"), F.col("first.head").alias("lead_head"))
    stars = lists.withColumn("band", of_band).join(leaders, ["token", "band"]).where("gid <> lead").groupBy("lead", "lead_n", "lead_head", "gid", "n", "head").agg(F.count("*").alias("seen"))
    stars = stars.where(f"seen * 2 >= {prefix_overlap_needed('n', 'lead_n', percent)}").select(F.col("lead_head").alias("a"), F.col("head").alias("b"))
    inner = in_group.join(groups.select("gid", "head"), "gid").where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    links = found.linked(stars.union(inner), False)

    # Pairs that the first links leave open: of different components, by groups, then by members.
    comp = components(links)
    placed = written(in_group.join(comp.withColumnRenamed("v", "cls"), "cls", "left").select("gid", "cls", F.coalesce("comp", "cls").alias("comp")), "placed")
    spans = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_lists = lists.select("token", "gid", "n", "pos", "late", "commons", "rare").join(spans, "gid")
    mixed = open_lists.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.min(F.struct("rare", "gid", "low")).alias("first")).where("l <> h").select("token", F.col("first.low").alias("main"))
    open_lists = written(open_lists.join(mixed, "token"), "open-lists", compression="zstd")
    other = open_lists.withColumn("is_main", F.expr("low = high and low = main"))
    pairs = group_pairs(open_lists.where("low <> high or low <> main"), other, percent, "(is_main or g < gid) and not (low = high and g_low = g_high and low = g_low)")
    left = placed.select(F.col("gid").alias("g"), F.col("cls").alias("a"), F.col("comp").alias("a_comp"))
    right = placed.select(F.col("gid").alias("h"), F.col("cls").alias("b"), F.col("comp").alias("b_comp"))
    across = pairs.join(left, "g").join(right, "h").where("a_comp <> b_comp").select("a", "b")
    split = written(placed.join(spans.where("low <> high").select("gid"), "gid", "left_semi"), "split-groups")
    within = pairs_within(split, found.rows, classes, width, percent, found.common)
    more = found.linked(across.union(within), True)

    # Second components: over the first ones' labels, so that only what is new is joined.
    label = placed.select("cls", "comp")
    bridges = more.join(label.select(F.col("cls").alias("a"), F.col("comp").alias("x")), "a").join(label.select(F.col("cls").alias("b"), F.col("comp").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    top = components(bridges).select(F.col("v").alias("comp"), F.col("comp").alias("top"))
    final = label.join(top, "comp", "left").select("cls", F.coalesce("top", "comp").alias("comp"))
    final = classes.join(final, "cls").select("cls", "comp", "least", "class_size")
    smallest = final.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = written(final.join(smallest, "comp").select("cls", "component_id", "class_size"), "class-components")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(of_class, "cls", "left").select(ROW, "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The input's rows with one document of each component: the one whose id names it, of repeated ids the first row. Rows of a component without any id stay."""
    row = unused(docs, ROW)
    numbered = in_file_order(docs, row)
    found = near_duplicates(numbered, id_column, text_column, width, percent, F.col(row))
    kept = found.where("component_id = doc_id").groupBy("component_id").agg(F.min(ROW).alias(row)).select(row)
    kept = kept.union(found.where("component_id is null").select(F.col(ROW).alias(row)))
    return numbered.join(kept, row, "left_semi").select(*map(quoted, docs.columns))
