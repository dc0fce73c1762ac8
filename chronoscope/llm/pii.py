"""Personal data in texts, in DataFrame functions only.

A regular expression for each kind proposes spans, a validator (part ranges, digit
counts, Luhn, mod 97) confirms them and words nearby adjust their score. The kinds
email, ip, card and phone keep every confirmed span. The added kinds ``iban`` and
``ssn`` need a score of LEAST_SCORE: an IBAN has it by its check digits, an
``ssn`` only where a context word stands nearby.

The expressions carry possessive quantifiers and starts that a match can't have
missed, so a text of one very long word costs time in proportion to its length;
what they match is the same as without. Offsets are added up in runs and contexts
cut from blocks of the text, so many spans in a long text cost no square of them.

Defined results: a null or empty text has no spans, count 0 and the digest of an
empty string; rows with the same id are treated each for itself; offsets count
code points of the original text; spans of one start are listed by kind; a text of any
length is searched to its end; an empty table gives an empty result; further columns
are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Kind, what a text must have at all, candidates. The order is that of spans with the same start.
KINDS = [
    ("email", "@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", "-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
]
BASE = ("email", "ip", "card", "phone")
#: Context words of each kind, and what a span scores without and with one of them in WINDOW characters on either side.
CONTEXT = {
    "email": (r"\b(?:e-?mail|mail|contact|write)\b", 0.9, 1.0),
    "ip": (r"\b(?:ip|address|host|server|login)\b", 0.6, 0.9),
    "card": (r"\b(?:card|visa|mastercard|amex|credit|payment)\b", 0.7, 1.0),
    "phone": (r"\b(?:phone|tel|call|mobile|fax)\b", 0.7, 1.0),
    "iban": (r"\b(?:iban|bank|account|konto|compte|cuenta)\b", 0.9, 1.0),
    "ssn": (r"\b(?:ssn|social security|tax id)\b", 0.3, 0.8),
}
WINDOW, LEAST_SCORE = 40, 0.5
#: Spans whose offsets are added up together; code points of the blocks that contexts are cut from.
RUN, BLOCK = 256, 2048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and in whatever lambda it is named."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<kind>: what ``step`` of a running offset and each item puts out (nothing, where null); it gives the next offset and an output.

    The output is built in runs of RUN items, so its time doesn't grow with the square of the items."""
    state, runs = f"struct<at:int,out:array<{kind}>>", f"struct<at:int,out:array<array<{kind}>>>"

    def add(s: Column, x: Column) -> Column:
        at, out = step(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], F.array_compact(F.array(out))).alias("out")).cast(state)

    def of(items: Column) -> Column:
        def run(s: Column, first: Column) -> Column:
            begun = F.struct(s["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")).cast(state)
            done = F.aggregate(F.slice(items, first, F.lit(RUN)), begun, add)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out")).cast(runs))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")).cast(runs)
        out = F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(RUN)), none, run, lambda s: F.flatten(s["out"]))
        return F.when(F.size(items) > 0, out).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, of)


def matches(text: Column, needed: str, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches, leftmost and non-overlapping; offsets in code points.

    The texts between matches (split) and the matches themselves alternate, so their lengths add up to the offsets."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(F.zip_with(gaps, found, lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("found"))), lambda x: x["found"].isNotNull())

    def span(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["found"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))

    kind = "struct<start:int,end:int,found:string>"
    return F.when(text.rlike(needed), scan(steps, kind, span)).otherwise(F.array().cast(f"array<{kind}>"))


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, the last one shorter."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The text of ``blocks`` between two offsets; only the blocks in between are walked through."""
    first = F.floor(start / BLOCK).cast("int")
    return F.substr(F.array_join(F.slice(parts, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), ""), start - first * BLOCK + 1, end - start)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at least one digit passes the Luhn check."""
    backwards = F.reverse(number)

    def worth(i: Column) -> Column:
        x = F.substr(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an IBAN without spaces, of at least five characters, has the remainder 1."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        x = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(x < 58, (rest * 10 + x - 48) % 97).otherwise((rest * 100 + x - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def valid(kind: str, found: Column) -> Column:
    number = digits(found)
    bare = F.replace(found, F.lit(" "), F.lit(""))
    return {
        "email": F.lit(True),
        "ip": found.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False),
        "phone": F.length(number).between(9, 15),
        "iban": F.when(F.length(bare).between(15, 34), mod_97(bare)).otherwise(False),
        "ssn": ~found.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]


def spans(text: Column, rank: int) -> Column:
    """array<struct<start, rank, end, kind, score>> of the confirmed spans of a kind."""
    kind, needed, pattern = KINDS[rank]
    words, without, near = CONTEXT[kind]

    def scored(parts: Column, x: Column) -> Column:
        around = F.concat_ws("|", piece(parts, F.greatest(x["start"] - WINDOW, F.lit(0)), x["start"]), piece(parts, x["end"], x["end"] + WINDOW))
        score = F.when(F.lower(around).rlike(words), near).otherwise(without)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    confirmed = F.filter(matches(text, needed, pattern), lambda x: valid(kind, x["found"]))
    parts = lambda found: F.when(F.size(found) > 0, blocks(text))
    all_scored = let(confirmed, lambda found: let(parts(found), lambda p: F.transform(found, lambda x: scored(p, x))))
    return F.filter(all_scored, lambda x: F.lit(kind in BASE) | (x["score"] >= LEAST_SCORE))


def personal_data(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df with pii: array<struct<start, rank, end, kind, score>>, by start and then kind. A column of that name is replaced."""
    df = df.drop("pii")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return df.withColumn("pii", F.array_sort(F.concat(*(spans(text, rank) for rank in range(len(KINDS))))))


def redacted(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``personal_data`` with each span in the text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))

    def cut(at: Column, x: Column) -> tuple[Column, Column]:
        taken = x["start"] >= at
        return F.when(taken, x["end"]).otherwise(at), F.when(taken, F.struct(at.alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    def clean(cuts: Column, parts: Column) -> Column:
        shown = F.transform(cuts, lambda c: F.concat(piece(parts, c["at"], c["start"]), F.lit("<"), c["kind"], F.lit(">")))
        return F.concat(F.array_join(shown, ""), piece(parts, F.coalesce(F.try_element_at(cuts, F.lit(-1))["end"], F.lit(0)), F.length(text)))

    cuts = scan(F.col("pii"), "struct<at:int,start:int,end:int,kind:string>", cut)
    return personal_data(df, text_column).withColumn(text_column, let(cuts, lambda c: let(blocks(text), lambda p: clean(c, p))))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def pii_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans and their scores as strings."""
    found = personal_data(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))).select("doc_id", "pii")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.filter("pii", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``pii_digest``'s rows. Its expressions have no look-around, so what stands beside a candidate is tested apart."""
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", None),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0", None),
        ("card", r"[0-9]([\x20-]?[0-9])+", "len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[-i] AS INT) ELSE (CAST(d[-i] AS INT) * 2) // 10 + (CAST(d[-i] AS INT) * 2) % 10 END)) % 10 = 0", None),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15", None),
        ("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", "len(replace(x, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(replace(x, ' ', '')[5:] || x[:4], ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1", "[A-Za-z0-9]"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$')", "[0-9-]"),
    ]
    parts = []
    for rank, (kind, pattern, test, beside) in enumerate(plain):
        words, without, near = CONTEXT[kind]
        edge = "true" if beside is None else f"NOT regexp_matches(t[s:s], '^{beside}') AND NOT regexp_matches(t[e + 1:e + 1], '^{beside}')"
        parts.append(f"""SELECT doc_id, s, {rank} AS rank, e, '{kind}' AS kind,
  CASE WHEN regexp_matches(lower(concat_ws('|', t[greatest(s - {WINDOW}, 0) + 1:s], t[e + 1:e + {WINDOW}])), '{words}') THEN {near} ELSE {without} END AS score
FROM (SELECT *, s + len(x) AS e, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM (
  SELECT doc_id, t, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0))) AS s
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts)))
WHERE {test} AND {edge}""")
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, CAST(s AS INT) AS s, rank, CAST(e AS INT) AS e, kind, score FROM ({' UNION ALL '.join(parts)}) WHERE rank < {len(BASE)} OR score >= {LEAST_SCORE}),
by_doc AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(CAST(CAST(score AS DOUBLE) AS VARCHAR), ',' ORDER BY s, rank) AS scores FROM found GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM texts LEFT JOIN by_doc USING (doc_id)"""
