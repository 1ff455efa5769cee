import hashlib
import re

import pytest

from tamarack.llm.pii import PATTERNS, find_spans, joined, redact

BASE = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for order, kind in enumerate(BASE):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


TEXTS = [
    None, "", "no data", "a@b.c and x.y+z@host-1.example.org, a@b@c.de", "a@b.c_d@e.f", "1.2.3.4 300.1.1.1 10.0.0.255 1.2.3.4.5.6.7.8 000001.2.3.4", "card 4539 1488 0343 6467, 4539-1488-0343-6467 4539148803436468 1 2 3",
    "+49 (30) 123-456.78 +1 +12345678 + 1234567890 +1234567890123456", "é🙂 a@b.cd 🙂 10.0.0.1", "x@y.z" * 300, "1 " * 5000, "a" * 50000 + "@", "a" * 20000 + "@b.c", "9" * 40000, "0" * 16, "+" * 300 + "1" * 12, "1.1.1.1.1.1.1.1" * 20,
]


def test_base_spans_are_those_of_the_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["s"] for r in find_spans(df).select("doc_id", joined(F_base()).alias("s")).collect()}
    for i, text in enumerate(TEXTS):
        assert out[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text)), (i, text and text[:80])


def F_base():
    from pyspark.sql import functions as F

    return F.filter("spans", lambda s: s["kind"].isin(*BASE))


@pytest.mark.parametrize(("text", "kinds"), [("IBAN DE89370400440532013000 ok", ["iban"]), ("IBAN DE89370400440532013001 no", []), ("his SSN is 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("SSN 000-45-6789", [])])
def test_added_kinds_need_checks_and_context(spark, text, kinds):
    spans = find_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["spans"]
    assert [s["kind"] for s in spans if s["kind"] not in BASE] == kinds
    assert all(text[s["start"] : s["end"]] == s["txt"] for s in spans)


def test_redaction_covers_overlaps_and_keeps_the_rest(docs):
    out = {r["doc_id"]: r["text"] for r in redact(docs([(1, "mail a@b.c, ip 10.0.0.1 end"), (2, None), (3, "plain"), (4, "tel +49 4539 1488 0343")])).collect()}
    assert out[1] == "mail [EMAIL], ip [IP] end" and out[2] is None and out[3] == "plain"
    assert "4539" not in out[4] and out[4].startswith("tel [")
    assert redact(docs([])).count() == 0


def test_repeated_rows_and_empty_digest(docs):
    found = find_spans(docs([(None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c")]))
    assert [len(r["spans"]) for r in found.collect()] == [1, 1, 1]
    assert "lang" in found.columns and hashlib.sha256(b"").hexdigest()
