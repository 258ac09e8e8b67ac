import hashlib
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spectraloom.llm import pii
from spectraloom.llm.queries import op1_pii


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
}


def brute(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in BASE.items() for m in re.finditer(pattern, text or "") if ok(m.group())]


def check(row, text):
    wanted = brute(text)
    assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), (text or "")[:200]
    counts = Counter(w.split(":")[0] for w in wanted)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts[k] for k in BASE)
    assert [s for s in row.spans.split(",") if s.split(":")[0] in BASE] == wanted


def test_query_equals_brute_force(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = op1_pii(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        check(row, texts[row.doc_id])


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}


def test_edges(spark):
    texts = [
        None, "", "a@b.c_d@e.f x+y@z..q a.b@c-d.e. 𝔘 x@y.zz", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 256.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (23) 45-67-89 +1 2 +++49 30 1234567 +1" + " " * 50, "1 " * 20_000, "a" * 50_000 + "@" + "b" * 50_000 + ".c",
        "x@y.z " * 3_000,
    ]
    for i, row in spans_of(spark, texts).items():
        check(row, texts[i])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a@.1 +-(4𝔘é\n", max_size=60), min_size=5, max_size=15))
def test_generated(spark, texts):
    for i, row in spans_of(spark, texts).items():
        check(row, texts[i])


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("my IBAN: DE89 3704 0044 0532 0130 00.", ["iban:9:36"]), ("GB82WEST12345698765432", ["iban:0:22"]), ("GB82WEST12345698765433", []),
        ("her ssn is 123-45-6789", ["identity:11:22"]), ("part 123-45-6789", []), ("ssn 000-45-6789", []),
        ("SSN: 123-45-6789, 234-56-7890", ["identity:5:16", "identity:18:29"]), ("123-45-6789/234-56-7890/345-67-8901 ssn", ["identity:0:11", "identity:12:23", "identity:24:35"]),
        ("ssn" + " " * 38 + "123-45-6789", []), ("ssn" + " " * 37 + "123-45-6789", ["identity:40:51"]),
    ],
)
def test_checksums_and_context(spark, text, added):
    row = spans_of(spark, [text])[0]
    assert [s for s in row.spans.split(",") if s and s.split(":")[0] not in BASE] == added


def test_scores_follow_the_words_nearby(spark):
    rows = spans_of(spark, ["e-mail a@b.c or x@y.z", "a@b.c" + "." * 41 + "e-mail", "call +1 234 567 890, IP 10.0.0.1", ""])
    assert [rows[i].scores for i in range(4)] == ["1.0,1.0", "0.9", "0.9,0.9", ""]
    text = " ".join(f"{i}@b.c" for i in range(30)) + " contact"
    near = [s == "1.0" for s in spans_of(spark, [text])[0].scores.split(",")]
    assert near == ["contact" in text[m.end() : m.end() + 40] for m in re.finditer(BASE["email"][0], text)]


def test_odd_tables(spark, odd_documents):
    found = pii.digest(pii.find_pii(odd_documents)).collect()
    assert len(found) == odd_documents.count()
    assert pii.digest(pii.find_pii(odd_documents.limit(0))).collect() == []


def test_no_python_in_the_plan(spark, documents):
    plan = pii.digest(pii.find_pii(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
