import hashlib
import re
import time

from pyspark.sql import functions as F

from chronoscope.llm import pii
from tests.llm import odd

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def good(kind, found):
    number = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(number) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(number)))
        return 12 <= len(number) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text) if good(kind, m.group()))


TEXTS = [
    "mail a.b+c@x-y.co.uk, a@b.c@d.e f@g a@b..c x@y.z_w@q.r @@ a@b.c.",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 1.2.3.4444 0.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 378282246310005 0000000000000 12",
    "+1 (706) 555-3138 +49 30 1234567 +1 2 +123456789012345678 +5.5 ++1 555 444 33 22x",
    "é😀é a@b.de 中文 10.0.0.1",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE89370400440532013001",
    "ssn 123-45-6789, and just 123-45-6789" + " " * 60 + "987-65-4321 000-12-3456",
    "pay by card: 4111111111111111",
    "+" * 50 + "1" * 12 + " " * 500,
    "1." * 300 + "1",
    "a@" * 200 + "b.c",
]


def digest(spans):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans).encode()).hexdigest()


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted(((i, *(sum(s[3] == k for s in base_spans(t or "")) for k, _ in BASE), digest(base_spans(t or ""))) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=str) == want


def test_base_spans(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    found = pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(found, rows)
    for r in found:  # base spans stay among all spans, in order
        all_spans = [s for s in r.spans.split(",") if s]
        base = [f"{kind}:{a}:{b}" for a, _, b, kind in base_spans(TEXTS[r.doc_id])]
        assert [s for s in all_spans if s.split(":")[0] in pii.BASE] == base
        assert len(r.scores.split(",")) == max(1, len(all_spans))
    by = {r.doc_id: r.spans for r in found}
    assert [s.split(":")[0] for s in by[5].split(",") if s.startswith("iban")] == ["iban", "iban"]
    assert by[6].count("ssn") == 2  # both near the word; the far one and the impossible one aren't


def test_odd_documents(spark, tmp_path):
    check(pii.pii_digest(odd.table(spark, tmp_path)).collect(), [r[:2] for r in odd.rows()])
    assert pii.pii_digest(odd.empty(spark, tmp_path)).collect() == []


def test_time_grows_with_the_length_of_a_word(spark):
    rows = [(0, "a" * 400_000 + " " + "1" * 400_000 + " " + "1 " * 200_000 + "+" + "1" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    assert pii.pii_digest(docs).collect()[0].n_email == 0
    assert time.time() - began < 60


def test_time_grows_with_the_number_of_spans(spark):
    """Offsets, contexts and redaction of a text of many blocks and runs, with characters outside the basic plane."""
    text = "".join(f"é😀 call +1 555 {i:07d} or 10.0.{i % 256}.7, a{i}@b.de; " for i in range(16_667))
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.time()
    rows = pii.pii_digest(docs).collect()
    assert time.time() - began < 150
    check(rows, [(0, text)])
    assert rows[0].scores.count(",") == 50_000
    assert {s for s, k in zip(rows[0].scores.split(","), rows[0].spans.split(",")) if k.startswith("phone")} == {"1.0"}


def test_redaction_of_a_long_text(spark):
    head, tail = "x" * (2 * pii.BLOCK), "é" * (pii.BLOCK - 1)
    text = head + " a@b.de " + tail + "".join(f" {i}@c.de" for i in range(2 * pii.RUN))
    docs = spark.createDataFrame([(0, text), (1, "a@b.de"), (2, ""), (3, "a" * pii.BLOCK)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {0: head + " <email> " + tail + " <email>" * (2 * pii.RUN), 1: "<email>", 2: "", 3: "a" * pii.BLOCK}


def test_context_raises_the_score_and_redaction(spark):
    docs = spark.createDataFrame([(1, "pay by card 4111111111111111 now"), (2, "number 4111111111111111"), (3, None)], "doc_id long, text string").withColumn("pii", F.lit(1))
    found = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert found[1].pii[0].score > found[2].pii[0].score
    assert found[1].text == "pay by card <card> now" and found[3].text == ""


def test_query(spark, medium):
    from chronoscope.llm.registry import op7_pii

    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    check(op7_pii(spark, medium).collect(), [tuple(r) for r in docs])


def test_plan_has_no_python(spark, small):
    plan = pii.pii_digest(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
