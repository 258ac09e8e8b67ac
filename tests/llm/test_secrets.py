import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spectraloom.llm import secrets
from spectraloom.llm.queries import op5_secrets

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32),
]


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def check(row, text):
    wanted = brute(text)
    assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), (text or "")[:200]
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w.startswith(k) for w in wanted) for k, _, _ in BASE)
    assert [s for s in row.spans.split(",") if s.split(":")[0] in {k for k, _, _ in BASE}] == wanted


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}


def test_query_equals_brute_force(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = op5_secrets(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        check(row, texts[row.doc_id])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["token", "API_KEY", "=", ": ", '"', "abcdef0123", "AKIA", "ABCDEFGH1234", "0a" * 16, " ", "\n", "é𝔘", "passwd"]), max_size=14), min_size=4, max_size=10))
def test_generated(spark, parts):
    texts = ["".join(p) for p in parts]
    for i, row in spans_of(spark, texts).items():
        check(row, texts[i])


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
FAR = "x " * 300


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (KEY, []), (f"AKIAABCDEFGHIJKL {KEY}", ["access", "bare_key"]), (f"{KEY} {FAR} AKIAABCDEFGHIJKL", ["access"]), (f"AKIAABCDEFGHIJKL\n\n{KEY}", ["access"]),
        ("user: bob at https://db.example.com", []), ("user: bob, password: hunter2hunter2, https://db.example.com", ["identifier", "assign", "endpoint"]),
        ("user: bob, password: hunter2hunter2", ["assign"]), (f"https://db.example.com {FAR} user: bob password: hunter2hunter2", ["assign"]),
    ],
)
def test_weak_parts_need_their_complements(spark, text, kinds):
    row = spans_of(spark, [text, None, text])
    for i in (0, 2):
        assert sorted(s.split(":")[0] for s in row[i].spans.split(",") if s) == sorted(kinds)


def test_links_equal_brute_force(spark):
    """Nearest parts by running extremes against all pairs."""
    import random

    choice, rows = random.Random(5), []
    for key in range(30):
        for _ in range(choice.randint(1, 12)):
            start = choice.randrange(3000)
            rows.append((f"k{key}", start, secrets.KINDS.index(kind := choice.choice(secrets.KINDS)), kind, start + choice.randint(5, 60), choice.randrange(2)))
    df = spark.createDataFrame(rows, "key string, start long, nth int, kind string, end long, scope long")
    found = sorted((r.key, w.start, w.nth, w.kind, w.end, w.scope) for r in secrets.linked(df, reach=200).collect() for w in r.weak)

    def near(a, b):
        return a[0] == b[0] and a[5] == b[5] and (b[1] <= a[1] and a[1] - b[4] <= 200 or b[1] >= a[1] and b[1] - a[4] <= 200)

    wanted = [a for a in rows if a[3] in secrets.NEEDS and all(any(near(a, b) and secrets.CLASS[b[3]] == need for b in rows) for need in secrets.NEEDS[a[3]])]
    assert found == sorted(wanted) and found


def test_redaction(spark):
    texts = ["token=abcdefgh1 rest", f"AKIAABCDEFGHIJKL {KEY}!", "clean", None, "", "password=" + "0a" * 20 + " end é"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, key string")
    found = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert [found[i].text for i in range(6)] == ["[SECRET] rest", "[SECRET] [SECRET]!", "clean", None, "", "[SECRET] end é"]
    assert found[0].n_chars == len("[SECRET] rest") and found[2].n_chars == 5 and found[0].key == "k"


@pytest.mark.parametrize("small", [0, secrets.SMALL])
def test_redaction_of_many_spans(spark, small, monkeypatch):
    """Against a pass over the characters; linked parts are masked whether links are broadcast or not."""
    monkeypatch.setattr(secrets, "SMALL", small)
    choice = random.Random(5)
    pieces = ["token=abcdefgh1 ", "é𝔘 ", "password:" + "0a" * 20, " ", "0123456789abcdef" * 2, f" AKIAABCDEFGHIJKL {KEY} ", "login=someone ", "\n\n"]
    texts = ["".join(choice.choice(pieces) for _ in range(choice.randrange(60))) for _ in range(30)] + ["token=abcdefgh1 é " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}

    def plain(text, spans):
        out, at = [], 0
        for s in spans:
            if s.start >= at:
                out += [text[at : s.start], secrets.MASK]
            at = max(at, s.end)
        return "".join(out) + text[at:]

    got = {r.doc_id: r.text for r in secrets.redact(docs, length_column=None).collect()}
    assert got == {i: plain(t, found[i]) for i, t in enumerate(texts)}
    assert sum(any(s.kind in secrets.WEAK for s in f) for f in found.values()) > 5


def test_odd_tables(spark, odd_documents):
    assert len(secrets.digest(secrets.find_secrets(odd_documents)).collect()) == odd_documents.count()
    assert secrets.digest(secrets.find_secrets(odd_documents.limit(0))).collect() == []
    assert secrets.redact(odd_documents, length_column=None).columns == odd_documents.columns


def test_no_python_in_the_plan(spark, documents):
    plan = secrets.digest(secrets.find_secrets(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
