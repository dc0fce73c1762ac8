"""Compiled rules against a plain evaluator."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoscope.operators import sigma

EVENT_SCHEMA = "event_id long, channel string, computer string, provider string, event_data map<string,string>"


def yaml_rule(detection: str, head: str = "title: t\n") -> sigma.Rule:
    return sigma.parse_rule(head + "detection:\n" + "".join(f"  {x}\n" for x in detection.splitlines()))


def test_parsing():
    rule = yaml_rule("sel:\n  A|contains|all: [x, 1, true, null]\n  B: 0o17\n  C: 2020-01-02\n  D: yes\nother: [a, b]\ncondition: sel", "title: t\nid: abc\nlevel: HIGH\nlogsource: {product: windows}\n")
    assert (rule.title, rule.id, rule.level, rule.logsource) == ("t", "abc", "high", {"product": "windows"})
    assert rule.selections["sel"] == [sigma.FieldMatch("A", ("contains", "all"), ("x", "1", "true", "Null")), sigma.FieldMatch("B", (), ("0o17",)), sigma.FieldMatch("C", (), ("2020-01-02",)), sigma.FieldMatch("D", (), ("yes",))]
    assert rule.selections["other"] == []
    assert yaml_rule("s: {}\ncondition: s").level == "medium"


@pytest.mark.parametrize("text", ["", "- a", "title: t", "title: t\ndetection: x", "title: t\ndetection: {s: {a: 1}}", "title: t\nlevel: odd\ndetection: {condition: s}", "a: b: c", "title: t\ndetection: {condition: [a]}"])
def test_bad_rules(text):
    with pytest.raises(sigma.RuleError):
        sigma.parse_rule(text)


def evaluate(tokens, names):
    """The dialect read off a token list, without a tree."""
    at = [0]

    def primary():
        if at[0] >= len(tokens):
            return False
        t = tokens[at[0]]
        at[0] += 1
        if t == "(":
            value = either()
            at[0] += at[0] < len(tokens) and tokens[at[0]] == ")"
            return value
        return names.get(t, False)

    def negated():
        if at[0] < len(tokens) and tokens[at[0]] == "not":
            at[0] += 1
            return not primary()
        return primary()

    def run(word, part):
        value = part()
        while at[0] < len(tokens) and tokens[at[0]] == word:
            at[0] += 1
            other = part()
            value = (value or other) if word == "or" else (value and other)
        return value

    def either():
        return run("or", lambda: run("and", negated))

    return either()


def of_tree(node, names):
    if node.kind == "name":
        return names[node.text]
    values = [of_tree(p, names) for p in node.parts]
    return {"false": lambda: False, "not": lambda: not values[0], "and": lambda: all(values), "or": lambda: any(values)}[node.kind]()


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "c", "zz", "and", "or", "not", "(", ")", "1", "of"]), max_size=12), st.tuples(st.booleans(), st.booleans(), st.booleans()))
def test_conditions(tokens, values):
    names = dict(zip("abc", values))
    assert of_tree(sigma.parse_condition(" ".join(tokens), list(names)), names) == evaluate(tokens, names)


def test_extended_conditions():
    names = {"sel_a": True, "sel_b": False, "flt": False}

    def value(text, extended=True):
        return of_tree(sigma.parse_condition(text, list(names), extended), names)

    assert value("1 of sel_*") and not value("all of sel_*") and value("any of them") and not value("1 of nothing*")
    assert value("sel_a and not 1 of flt*") and not value("1 of sel_*", extended=False)


EVENTS = [
    (4624, "Security", "h1", "P", {"User": "Bob's", "Path": "C:\\Temp\\a.exe"}),
    (1, "Sysmon", "H2", "q", {"User": "", "EventID": "9"}),
    (None, None, None, None, {}),
    (7045, "System", "h3", "P", None),
    (4104, "PS", "h4", "P", {"Text": "Line\nWith 'quotes' and \\d+ 100%", "User": "ÄÖ"}),
]


def plain(match: sigma.FieldMatch, event) -> bool:
    fields = dict(event[4] or {}) | {k: v for k, v in {"EventID": None if event[0] is None else str(event[0]), "Channel": event[1], "Computer": event[2], "Provider": event[3]}.items()}
    value = fields.get(match.name)
    if value is None:
        return False
    tests = {
        "re": lambda w: re.search(w, value) is not None,
        "contains": lambda w: w.lower() in value.lower(),
        "startswith": lambda w: value.lower().startswith(w.lower()),
        "endswith": lambda w: value.lower().endswith(w.lower()),
    }
    kind = next((k for k in tests if k in match.modifiers), None)
    hits = [tests[kind](w) if kind else value.lower() == w.lower() for w in match.values]
    return all(hits) if "all" in match.modifiers else any(hits)


MATCHES = [
    sigma.FieldMatch(name, modifiers, values)
    for name in ("User", "Path", "Text", "EventID", "Channel", "Missing")
    for modifiers in ((), ("contains",), ("startswith",), ("endswith", "all"), ("re",), ("unknown",))
    for values in (("bob's", "C:\\Temp"), ("4624",), (".exe",), ("\\d+ 100%",), ("äö",), ("Sys",))
    if not ("re" in modifiers and any(v.startswith("C:\\") for v in values))
]


def test_matches(spark):
    events = spark.createDataFrame([(i, *e) for i, e in enumerate(EVENTS)], "i int, " + EVENT_SCHEMA)
    rules = [sigma.Rule(f"r{k}", "not s" if k % 2 else "s", selections={"s": [m]}) for k, m in enumerate(MATCHES)]
    found = {(r.i, r.rule_ord) for r in sigma.detect(events, rules, chunk=70).collect()}
    assert found == {(i, k) for i, e in enumerate(EVENTS) for k, m in enumerate(MATCHES) if plain(m, e) != bool(k % 2)}


def test_foreign_and_broken_patterns_never_match(spark):
    events = spark.createDataFrame([EVENTS[0]], EVENT_SCHEMA)
    rules = [sigma.Rule("r", "s", selections={"s": [sigma.FieldMatch("User", ("re",), (p,))]}) for p in ("(?=Bob)", "(B)\\1", "B++", "(", "[")]
    assert sigma.detect(events, rules).count() == 0 and sigma.detect(events, []).count() == 0
    assert "rule_title" in sigma.detect(events, []).columns


def test_rule_folder(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.yml").write_text("title: two\ndetection: {s: {a: 1}, condition: s}")
    (tmp_path / "a.yaml").write_text("title: one\ndetection: {s: {a: 1}, condition: s}")
    (tmp_path / "bad.yml").write_text("title: [")
    (tmp_path / "no.txt").write_text("title: three")
    rules, bad = sigma.load_rules(str(tmp_path))
    assert [r.title for r in rules] == ["one", "two"] and bad == 1


def test_regular_expressions_of_the_dialect(spark):
    """What the dialect has matches as it says; what it refuses never does and is listed."""
    cases = [
        (r"\p{L}+", "é", True), ("foo(?i)bar", "fooBAR", True), ("foo(?i)bar", "FOObar", False), (r"\x{41}", "A", True), (r"a\z", "ba", True), ("[*+]x", "+x", True),
        ("^[[:alpha:]]+$", "abc", True), ("^[[:alpha:]]+$", "a1", False), ("[[:^digit:]]", "12", False), ("a$", "a\n", False), ("(?m)a$", "a\nb", True), (r"(?P<n>a|b)+c", "abc", True),
        ("a**b", "aab", True), ("^x{2}{2}$", "xxxx", True), ("^[]a]+$", "]a", True), (r"^\w+$", "naïve", True), (r"\bé", "x é", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False),
        (r"^[a-z&&[^b]]+$", "acd", True), (r"^[a-z&&[^b]]+$", "abc", False), (r"\p{Greek}", "λ", True), (r"\pL", "1", False), (r"C:\\Users\\[^\\]+\.exe$", "C:\\Users\\a.exe", True),
        ("(?=a)a", "a", None), ("a++", "aa", None), ("(ab)*+", "ab", None), (r"(a)\1", "aa", None), ("(?<!b)a", "a", None), ("*a", "*a", None), (r"\Qa", "a", None), ("a{", "a{", None), ("(a", "(a", None), ("a)", "a)", None), ("[a", "a", None), ("[a--b]", "a", None), ("[[:nope:]]", "n", None),
    ]
    rules = [sigma.Rule(f"r{i}", "s", selections={"s": [sigma.FieldMatch("f", ("re",), (p,))]}) for i, (p, *_) in enumerate(cases)]
    texts = spark.createDataFrame([(t, {"f": t}) for t in sorted({t for _, t, _ in cases})], "t string, event_data map<string,string>").selectExpr("*", "1 as event_id", "'c' as channel", "'m' as computer", "'p' as provider")
    hits = {(r.rule_ord, r.t) for r in sigma.detect(texts, rules).collect()}
    for i, (p, t, want) in enumerate(cases):
        assert ((i, t) in hits) == bool(want), (p, t)
    assert [p for _, _, p in sigma.refused_patterns(rules)] == [p for p, _, want in cases if want is None]


def random_rules(n: int, seed: int) -> list[sigma.Rule]:
    rng = random.Random(seed)
    fields = ["EventID", "Channel", "Provider", "User", "Cmd"]
    values = ["1", "2", "12", "007", "Bob", "security", "Sysmon", "abc", "abcd", "xabcy", "", "a.c", "net user", "NET"]

    def match():
        modifiers = rng.choice([(), (), ("contains",), ("startswith",), ("endswith",), ("re",), ("contains", "all"), ("all",), ("base64",)])
        return sigma.FieldMatch(rng.choice(fields), modifiers, tuple(rng.choices(values, k=rng.randint(0, 3))))

    def condition(depth=0):
        if depth > 2 or rng.random() < 0.4:
            return rng.choice(["s0", "s1", "s2", "not s0", "missing"])
        return f"({condition(depth + 1)} {rng.choice(['and', 'or'])} {condition(depth + 1)})"

    return [sigma.Rule(f"r'{i}", condition(), rng.choice([None, f"id{i}"]), selections={f"s{k}": [match() for _ in range(rng.randint(0, 2))] for k in range(3)}) for i in range(n)]


def test_index_changes_no_result(spark):
    """Rules of every kind behind gates of two rules: the same hits as each rule tested by itself on every event."""
    from chronoscope.operators import rule_index

    rng = random.Random(8)
    texts = [None, "", "Bob", "xABCDy", "a.c", "net user /add", "security", "1", "007"]
    rows = [(i, rng.choice([1, 2, 7, 12, None]), rng.choice(["Security", "sysmon", None]), "h", rng.choice(["Sysmon", "x", None]), {k: v for k in ("User", "Cmd") if (v := rng.choice(texts)) is not None}) for i in range(120)]
    events = spark.createDataFrame(rows, "i long, event_id long, channel string, computer string, provider string, event_data map<string,string>")
    rules = random_rules(300, 9)
    want = set()
    for at in range(0, len(rules), 50):
        tests = events.selectExpr("i", *(f"{sigma.rule_sql(r)} as t{k}" for k, r in enumerate(rules[at : at + 50])))
        want |= {(row.i, at + k) for row in tests.collect() for k in range(len(rules[at : at + 50])) if row[f"t{k}"]}
    found = sigma.detect(events, rules, chunk=2).select("i", "rule_ord", "rule_title", "rule_id").collect()
    assert {(r.i, r.rule_ord) for r in found} == want and len(found) == len(want) > 500
    assert all(r.rule_title == rules[r.rule_ord].title and r.rule_id == rules[r.rule_ord].id for r in found)
    kinds = {(g.test or "").split(" ")[0] for g in rule_index.gates(rules, {f: (f, f) for f in ("EventID", "Channel", "Provider", "User", "Cmd")})}
    assert kinds >= {"event_id", "Channel", "Provider", "User", "Cmd", ""}


def test_needs():
    from chronoscope.operators.rule_index import pattern_of, rule_needs

    rule = yaml_rule("a: {EventID: [1, 2], Cmd|contains: [abc, de]}\nb: {EventID: 3}\nc: {Cmd|contains|all: [abc, longer]}\ncondition: a or b")
    assert rule_needs(rule) == {("is", "EventID"): {"1", "2", "3"}}
    rule.condition = "c and not b"
    assert rule_needs(rule) == {("has", "Cmd"): {"longer"}}
    rule.condition = "c and b"
    assert rule_needs(rule) == {("has", "Cmd"): {"longer"}, ("is", "EventID"): {"3"}}
    for condition, want in (("not a", {}), ("nothing", None), ("a and nothing", None), ("b or nothing", {("is", "EventID"): {"3"}})):
        rule.condition = condition
        assert rule_needs(rule) == want
    texts = ["abc", "abd", "xa.*", "ab", "q(", "\\w", "é漢", "x" * 5000]
    assert all(re.search(pattern_of(texts), f"--{t}--") for t in texts)
    assert not re.search(pattern_of(["abc", "abd", "xa.*"]), "abe xaab")


def test_many_rules_are_one_scan(spark, small):
    from chronoscope import catalog
    from chronoscope.plans.fixtures import event_log

    plan = sigma.detect(event_log(spark, small), catalog.rule_set())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
