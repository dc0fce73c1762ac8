"""Sigma rules as SQL predicates.

A rule's YAML is read once on the driver, its condition parsed to a tree and the
whole compiled to one boolean SQL text, so an event is tested against every rule in
generated code. Many rules are kept behind an index (``rule_index``), and all are tested in one scan.

The dialect is the plain one: and, or, not, parentheses and names of selections; a
missing field never matches; an unknown name is false; what follows a complete
condition is ignored; a second ``not`` in a row is read as an unknown name. With
``extended=True`` ``1 of x*``, ``all of x*`` and ``... of them`` are understood too.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("informational", "low", "medium", "high", "critical")
#: Rules of one array of tests; more make the generated code slow.
CHUNK = 250
#: Fields that an event has besides its data; they win over data of the same name.
EVENT_FIELDS = {"EventID": "cast(event_id as string)", "Channel": "channel", "Computer": "computer", "Provider": "provider"}


class RuleError(ValueError):
    """A rule that can't be used."""


class _Core(yaml.SafeLoader):
    """YAML 1.2 scalars: no dates, octals or yes/no."""


_Core.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
    ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
):
    _Core.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first) + ([""] if _tag == "null" else []))


@dataclass(frozen=True)
class FieldMatch:
    name: str
    modifiers: tuple[str, ...]
    values: tuple[str, ...]


@dataclass
class Rule:
    title: str
    condition: str
    id: str | None = None
    level: str = "medium"
    logsource: dict = field(default_factory=dict)
    selections: dict[str, list[FieldMatch]] = field(default_factory=dict)


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "Null" if value is None else str(value)


def parse_rule(text: str) -> Rule:
    try:
        found = yaml.load(text, _Core)  # noqa: S506 - a SafeLoader
    except yaml.YAMLError as error:
        raise RuleError(str(error)) from error
    if not isinstance(found, dict) or not isinstance(found.get("title"), str):
        raise RuleError("a rule needs a title")
    detection = found.get("detection")
    if not isinstance(detection, dict) or not isinstance(detection.get("condition"), str):
        raise RuleError("a rule needs a detection with a condition")
    level = found.get("level", "medium")
    if not isinstance(level, str) or level.lower() not in LEVELS:
        raise RuleError(f"unknown level {level!r}")
    selections = {}
    for name, body in detection.items():
        if name == "condition":
            continue
        matches = []
        for key, value in body.items() if isinstance(body, dict) else ():
            column, *modifiers = str(key).split("|")
            values = value if isinstance(value, list) else [value]
            matches.append(FieldMatch(column, tuple(modifiers), tuple(_text(v) for v in values)))
        selections[str(name)] = matches
    identifier = found.get("id")
    source = found.get("logsource")
    return Rule(found["title"], detection["condition"], _text(identifier) if identifier is not None else None, level.lower(), source if isinstance(source, dict) else {}, selections)


def load_rules(folder: str) -> tuple[list[Rule], int]:
    """The rules of all .yml and .yaml files under a folder, by path, and how many files aren't rules."""
    rules, bad = [], 0
    for top, folders, files in os.walk(folder):
        folders.sort()
        for name in sorted(files):
            if name.endswith((".yml", ".yaml")):
                try:
                    with open(os.path.join(top, name), encoding="utf-8") as file:
                        rules.append(parse_rule(file.read()))
                except (RuleError, UnicodeDecodeError):
                    bad += 1
    return rules, bad


# Conditions


@dataclass(frozen=True)
class Node:
    """kind: and, or, not (with parts), name (with text) or false."""

    kind: str
    parts: tuple["Node", ...] = ()
    text: str = ""


FALSE = Node("false")


class _Parser:
    def __init__(self, condition: str, names: list[str], extended: bool):
        self.tokens = re.findall(r"[()]|[^\s()]+", condition)
        self.names, self.extended, self.at = names, extended, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str | None:
        token = self.peek()
        self.at += 1
        return token

    def chain(self, word: str, part) -> Node:
        found = [part()]
        while self.peek() == word:
            self.at += 1
            found.append(part())
        return found[0] if len(found) == 1 else Node(word, tuple(found))

    def any(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negated))

    def negated(self) -> Node:
        if self.peek() == "not":
            self.at += 1
            return Node("not", (self.primary(),))
        return self.primary()

    def primary(self) -> Node:
        token = self.take()
        if token is None:
            return FALSE
        if token == "(":
            inside = self.any()
            if self.peek() == ")":
                self.at += 1
            return inside
        if self.extended and token in ("1", "any", "all") and self.peek() == "of":
            self.at += 1
            pattern = self.take() or ""
            wanted = [n for n in self.names if pattern == "them" or re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), n)]
            if not wanted:
                return FALSE
            return Node("and" if token == "all" else "or", tuple(Node("name", text=n) for n in wanted))
        return Node("name", text=token) if token in self.names else FALSE


def parse_condition(condition: str, names: list[str], extended: bool = False) -> Node:
    return _Parser(condition, names, extended).any()


# Compilation


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Regular expressions. Rules are written for a dialect without look-around and back references, in which classes are
# Unicode's and $ is the very end. They are rewritten for Java; what the dialect refuses never matches.

# Named classes inside brackets (ASCII), and what may follow a backslash besides signs.
POSIX = {"alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": r"\w", "xdigit": "0-9A-Fa-f"}
SAME_ESCAPES = set("aftnrAbBdDsSwWz")


class _Regex:
    """Reads a pattern once and writes it for Java; raises RuleError where the dialect has no such pattern."""

    def __init__(self, pattern: str):
        self.text, self.at, self.lines, self.unicode = pattern, 0, False, False

    def fail(self) -> None:
        raise RuleError(f"not a pattern of the dialect: {self.text!r}")

    def take(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern).match(self.text, self.at)
        self.at = found.end() if found else self.at
        return found

    def escape(self) -> str:
        if found := self.take(r"\\x\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})"):
            code = int(next(g for g in found.groups() if g), 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                self.fail()
            return f"\\x{{{code:x}}}"
        if found := self.take(r"\\([pP])(?:\{(\^?)(\w+)\}|([A-Z]))"):
            sign, negated, name, short = found.groups()
            sign = {"p": "P", "P": "p"}[sign] if negated else sign
            name = short or name
            return f"\\{sign}{{{name if len(name) <= 2 else 'Is' + name}}}"
        found = self.take(r"\\(.)")
        if not found or (sign := found[1]).isdigit():
            self.fail()
        if sign == "v":
            return "\\x{b}"
        if sign.isalpha():
            if sign not in SAME_ESCAPES:
                self.fail()
            self.unicode |= sign in "bBdDsSwW"
            return "\\" + sign
        return "\\" + sign if sign.isascii() else sign

    def bracket(self) -> str:
        out = "[" + self.take(r"\[(\^?)")[1]
        if self.take(r"\]"):
            out += "\\]"
        while not self.take(r"\]"):
            if self.at >= len(self.text) or self.text.startswith(("--", "~~"), self.at) and not out.endswith("["):
                self.fail()
            if found := self.take(r"\[:(\^?)(\w+):\]"):
                if found[2] not in POSIX:
                    self.fail()
                out += f"[{found[1]}{POSIX[found[2]]}]"
            elif self.text[self.at] == "[":
                out += self.bracket()
            elif self.text[self.at] == "\\":
                out += self.escape()
            else:
                out += self.text[self.at]
                self.at += 1
        return out + "]"

    def java(self) -> str:
        out, opened, atom, repeated, closed = [], [], None, None, -1  # atom: where in out the last thing begins that can be repeated
        while self.at < len(self.text):
            sign = self.text[self.at]
            if sign == "(":
                if found := self.take(r"\(\?P?<[A-Za-z_]\w*>|\((?!\?)"):
                    opened.append(len(out))
                    out.append("(?:")
                elif found := self.take(r"\(\?([imsux]*)(?:-([imsx]+))?([:)])"):
                    on, off, end = found.groups()
                    self.lines |= "m" in on
                    self.unicode |= "i" in on
                    flags = on.replace("u", "") + (f"-{off}" if off else "")
                    if end == ":":
                        opened.append(len(out))
                        out.append(f"(?{flags}:")
                    elif flags:
                        out.append(f"(?{flags})")
                else:
                    self.fail()
                atom = None
            elif sign == ")":
                if not opened:
                    self.fail()
                self.at += 1
                atom = opened.pop()
                out.append(")")
            elif found := self.take(r"[*+?]\??|\{\d+(?:,\d*)?\}\??"):
                if atom is None:
                    self.fail()
                sign = found[0][0]
                if sign == "+" and closed == len(out):  # possessive elsewhere
                    self.fail()
                if sign != "{" and repeated and repeated[0] == atom and atom == len(out) - 1:  # a repetition of a repetition
                    inner, first = repeated[1:]
                    sign = first if first == sign else "*"
                else:
                    inner = "".join(out[atom:])
                out[atom:] = ["(?:" + inner + (found[0] if sign == "{" else sign) + ")"]
                repeated, closed = (atom, inner, sign) if sign != "{" else None, len(out)
            elif sign in "{":
                self.fail()
            else:
                begin = len(out)
                if sign == "[":
                    out.append(self.bracket())
                elif sign == "\\":
                    out.append(self.escape())
                else:
                    self.at += 1
                    out.append({"}": "\\}", "]": "\\]"}.get(sign, sign))
                atom = None if sign in "|" else begin
        if opened:
            self.fail()
        whole = "".join(out)
        if not self.lines:
            whole = re.sub(r"(\\.|\[(?:\\.|[^\]\\])*\])|\$", lambda m: m[1] or "\\z", whole)
        return ("(?dU)" if self.unicode else "(?d)") + whole


def java_regex(pattern: str) -> str | None:
    """The pattern for Java, or None where the dialect refuses it (look-around, back references, unknown escapes and classes, stray signs)."""
    try:
        return _Regex(pattern).java()
    except (RuleError, IndexError):
        return None


def refused_patterns(rules: list[Rule]) -> list[tuple[str, str, str]]:
    """(rule, field, pattern) of every regular expression that never matches because the dialect refuses it."""
    return [(r.title, m.name, v) for r in rules for found in r.selections.values() for m in found if "re" in m.modifiers for v in m.values if java_regex(v) is None]


def field_sql(name: str, data: str) -> str:
    if name in EVENT_FIELDS:
        return EVENT_FIELDS[name]
    return f"{data}[{literal(name)}]"


def match_sql(match: FieldMatch, data: str, columns: dict[str, tuple[str, str]] | None = None) -> str:
    """One field's test; null never gets out of it. ``columns`` names columns that hold fields, and their lower case."""
    value = field_sql(match.name, data)
    value, low = (columns or {}).get(match.name, (value, f"lower({value})"))
    kind = next((m for m in ("re", "contains", "startswith", "endswith") if m in match.modifiers), "exact")
    tests = []
    for wanted in match.values:
        lower = literal(wanted.lower())
        if kind == "re":
            pattern = java_regex(wanted)
            tests.append("false" if pattern is None else f"{value} rlike {literal(pattern)}")
        elif kind == "exact":
            tests.append(f"{low} = {lower}")
        else:
            tests.append(f"{kind}({low}, {lower})")
    joined = (" and " if "all" in match.modifiers else " or ").join(tests) or ("true" if "all" in match.modifiers else "false")
    return f"({value} is not null and coalesce({joined}, false))"


def rule_sql(rule: Rule, data: str = "event_data", extended: bool = False, columns: dict[str, tuple[str, str]] | None = None) -> str:
    """The rule as a boolean SQL text that is never null."""

    def sql(node: Node) -> str:
        if node.kind == "false":
            return "false"
        if node.kind == "name":
            return "(" + (" and ".join(match_sql(m, data, columns) for m in rule.selections[node.text]) or "true") + ")"
        if node.kind == "not":
            return f"(not {sql(node.parts[0])})"
        return "(" + f" {node.kind} ".join(sql(p) for p in node.parts) + ")"

    return sql(parse_condition(rule.condition, list(rule.selections), extended))


def detect(events: DataFrame, rules: list[Rule], data: str = "event_data", extended: bool = False, chunk: int = CHUNK) -> DataFrame:
    """A row for each event and rule that fits: the event's columns, rule_ord, rule_title, rule_id and rule_level.

    The events are read once. Rules are kept behind gates (``rule_index``), so an event is
    tested against those that it may fit; the numbers of those that it does fit become rows,
    and titles are looked up afterwards. ``chunk`` is how many rules are in one array."""
    if not rules:
        return events.withColumns({"rule_ord": F.lit(0), "rule_title": F.lit(""), "rule_id": F.lit(""), "rule_level": F.lit("")}).limit(0)
    from chronoscope.operators.rule_index import gates

    fields = sorted({m.name for r in rules for found in r.selections.values() for m in found})
    columns = {name: (f"_field{i}", f"_lower{i}") for i, name in enumerate(fields)}
    once = [text for name, (value, low) in columns.items() for text in (f"{field_sql(name, data)} as {value}", f"lower({field_sql(name, data)}) as {low}")]
    hits = []
    for gate in gates(rules, columns, extended):
        for at in range(0, len(gate.rules), chunk):
            found = f"array({', '.join(f'if({rule_sql(rules[i], data, extended, columns)}, {i}, -1)' for i in gate.rules[at : at + chunk])})"
            hits.append(f"if({gate.test}, {found}, cast(array() as array<int>))" if gate.test else found)
    # The tests' code is to be cut into small methods, which run compiled; in whole-stage code it would be one method that is too large.
    # A lambda keeps its projection out of whole-stage code; this one gives -1, which stands for a rule that doesn't fit.
    none = "least(size(filter(array(event_id), x -> x is null)), 0) - 1"
    numbers = f"array_remove(flatten(array({', '.join(hits)})), {none})" if hits else "cast(array() as array<int>)"
    tested = events.selectExpr("*", *once).selectExpr(*(f"`{c.replace('`', '``')}`" for c in events.columns), f"{numbers} as _hits")
    # An inner explode would have its array tested for emptiness first, at the scan: all tests twice, each with its fields inlined.
    found = tested.selectExpr("*", "explode_outer(_hits) as rule_ord").where("rule_ord is not null").drop("_hits")
    titles, ids, levels = (f"array({', '.join(map(literal, texts))})" for texts in ([r.title for r in rules], [r.id or "" for r in rules], [r.level for r in rules]))
    unnamed = [i for i, r in enumerate(rules) if r.id is None]
    without = f"rule_ord in ({', '.join(map(str, unnamed))})" if unnamed else "false"
    return found.selectExpr("*", f"element_at({titles}, rule_ord + 1) as rule_title", f"if({without}, null, element_at({ids}, rule_ord + 1)) as rule_id", f"element_at({levels}, rule_ord + 1) as rule_level")


def count_by_level(detections: DataFrame) -> DataFrame:
    return detections.groupBy("rule_level").agg(F.count("*").alias("n"))
