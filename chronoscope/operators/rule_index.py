"""An index over many Sigma rules, so that one scan of the events tests few of them on each event.

From every rule's condition follow values that an event must have for the rule to fit:
one of some event ids, channels or providers, or one of some texts within a field. Rules
that need the same are kept together behind one test of that need (their gate), and a
gate's rules are only looked at for events that pass it. Needs are necessary, not
sufficient: the rule itself is still tested, so an index changes no result.

Texts within a field are looked for with one expression for many rules, whose pattern
follows the texts' common beginnings, so an event's field is read once for all of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from chronoscope.operators import sigma

#: A need: ("is", field) with lower-case values of which the field must be one, or ("has", field) with texts of which it must hold one.
Needs = dict[tuple[str, str], frozenset[str]]
#: Fields whose values sort events, the most telling first.
KEYS = ("EventID", "Channel", "Provider")
#: Texts shorter than this tell too little; rules behind one gate of texts.
LEAST_TEXT, RULES_A_GATE = 3, 64


def match_needs(match: sigma.FieldMatch) -> Needs | None:
    """What one field's test needs; None where it never holds, nothing where it can't be said."""
    values, every = [v.lower() for v in match.values], "all" in match.modifiers
    if not values:
        return {} if every else None
    kind = next((m for m in ("re", "contains", "startswith", "endswith") if m in match.modifiers), "exact")
    if kind == "re":
        return {}
    if kind == "exact" and match.name in KEYS:
        if every and len(set(values)) > 1:
            return None
        return {("is", match.name): frozenset(values)}
    texts = [max(values, key=len)] if every else values
    return {("has", match.name): frozenset(texts)} if min(map(len, texts)) >= LEAST_TEXT else {}


def both(parts: Iterable[Needs | None]) -> Needs | None:
    """What all of the parts together need: of several sets for one field the smallest says enough."""
    out: Needs = {}
    for part in parts:
        if part is None:
            return None
        for key, values in part.items():
            if key not in out or len(values) < len(out[key]):
                out[key] = values
    return out


def either(parts: Iterable[Needs | None]) -> Needs | None:
    """What must hold for one of the parts to hold: only what each of them needs."""
    possible = [part for part in parts if part is not None]
    if not possible:
        return None
    return {key: frozenset().union(*(part[key] for part in possible)) for key in possible[0] if all(key in part for part in possible)}


def rule_needs(rule: sigma.Rule, extended: bool = False) -> Needs | None:
    """What an event must have for the rule to fit; None for a rule that fits none."""

    def needs(node: sigma.Node) -> Needs | None:
        if node.kind == "false":
            return None
        if node.kind == "name":
            return both(match_needs(m) for m in rule.selections[node.text])
        if node.kind == "not":
            return {}
        return (both if node.kind == "and" else either)(needs(p) for p in node.parts)

    return needs(sigma.parse_condition(rule.condition, list(rule.selections), extended))


def pattern_of(texts: Iterable[str]) -> str:
    """A regular expression that finds whether one of the texts is within another, by their common beginnings."""
    tree: dict = {}
    for text in texts:
        node = tree
        for sign in text:
            if node.get("") is True:  # a shorter one is found already
                break
            node = node.setdefault(sign, {})
        else:
            node.clear()
            node[""] = True

    out: list[str] = []
    stack: list = [tree]
    while stack:  # texts may be longer than Python's calls go deep
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        branches = [(sign, below) for sign, below in node.items() if sign]
        todo: list = []
        for i, (sign, below) in enumerate(branches):
            todo += [("|" if i else "") + _escaped(sign), below]
        stack += reversed([*(["(?:"] if len(branches) > 1 else []), *todo, *([")"] if len(branches) > 1 else [])])
    return "".join(out)


def _escaped(sign: str) -> str:
    return sign if sign.isalnum() or not sign.isascii() else f"\\x{ord(sign):02x}"


@dataclass(frozen=True)
class Gate:
    """Rules, by their number, that fit only events for which the SQL test holds; no test lets every event pass."""

    test: str | None
    rules: tuple[int, ...]


def gates(rules: list[sigma.Rule], columns: dict[str, tuple[str, str]], extended: bool = False, rules_a_gate: int = RULES_A_GATE) -> list[Gate]:
    """All rules but those that fit nothing, each behind one gate. ``columns`` names the columns that hold the fields, and their lower case."""
    by_key: dict = defaultdict(list)
    by_text: dict = defaultdict(list)
    rest = []
    for i, rule in enumerate(rules):
        found = rule_needs(rule, extended)
        if found is None:
            continue
        key = next((("is", f) for f in KEYS if ("is", f) in found), None)
        if key:
            by_key[key[1], found[key]].append(i)
        elif found:
            field = max(found, key=lambda k: min(map(len, found[k])))
            by_text[field[1]].append((sorted(found[field]), i))
        else:
            rest.append(i)
    out = []
    for (field, values), numbers in sorted(by_key.items(), key=lambda x: x[1][0]):
        if field == "EventID":
            ids = sorted(int(v) for v in values if v.isdecimal() and str(int(v)) == v and int(v) < 1 << 63)
            test = f"event_id in ({', '.join(f'{v}L' for v in ids)})" if ids else "false"
        else:
            test = f"{columns[field][1]} in ({', '.join(map(sigma.literal, sorted(values)))})"
        out.append(Gate(test, tuple(numbers)))
    for field, found in sorted(by_text.items()):
        found.sort()
        for at in range(0, len(found), rules_a_gate):
            part = found[at : at + rules_a_gate]
            pattern = pattern_of(sorted({t for texts, _ in part for t in texts}, key=len))
            out.append(Gate(f"{columns[field][1]} rlike {sigma.literal(pattern)}", tuple(sorted(i for _, i in part))))
    for at in range(0, len(rest), rules_a_gate):
        out.append(Gate(None, tuple(rest[at : at + rules_a_gate])))
    return out
