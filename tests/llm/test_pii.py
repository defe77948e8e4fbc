"""Personal data: base spans against the plain patterns, added spans, estimated reliabilities."""

import hashlib
import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuspack.llm import pii

# the base patterns as they are defined
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 13 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                yield kind, m.start(), m.end()


HARD = ["a@b.c_foo@bar.org x", "1.2.3.4.5.6.7.8", "éé x@y.de, 300.1.1.1 +123456789 +49 (0)30 1234-5678 5500000000000004", "9" * 3000, "1 " * 3000,
        "x@" * 500 + "y.z", "+" * 100 + "1 234567890", "a" * 5000 + "@b.c", "4111-1111-1111-1111 " * 300, "0.0.0.0 255.255.255.0256", "1" * 13, "5 -6",
        "4111 1111 1111 1111", "+1 2" + "." * 3000, "日本 +81 3 1234 5678, a.b+c@d-e.f-g.jp", "@@a@b..c", "12345678901234567890 4111111111111111 1"]


def texts(seed):
    rng = random.Random(seed)
    parts = ["4111 1111 1111 1111", "a@b.co", "1.2.3.4", "+1 (826) 555-4081", " ", " ", "-", ".", "7", "12", "é", "x@", "+", "\n", "255", "@y.z"]
    return HARD + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]


def test_base_spans(documents):
    rows = [(i, t) for i, t in enumerate(texts(6))]
    found = pii.personal_data(documents(rows, "doc_id long, text string"))
    digests = {r.doc_id: r for r in pii.digest(found).collect()}
    for i, t in rows:
        want = list(plain_spans(t))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = digests[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[0] for w in want) for k in pii.KINDS], t
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}


def test_added_spans(documents):
    rows = [(1, "call +1 (826) 555-4081 190.137.223.204 now"), (2, "cards 4111 1111 1111 1111 5500 0000 0000 0004 end"), (3, "no 1234 5678 9012 3456 7890 1 end")]
    rows += [(4, "write to jane.doe [at] mail [dot] example [dot] com today"), (5, "meet [at] the corner [dot] yes")]
    rows += [(10 + i, f"call +1 (8{i:02}) 555-40{i:02} or a{i}@b.com, 10.0.0.{i}, 4111 1111 1111 1111, id 9999 8888 7777 66{i:02}") for i in range(50)]
    spans = {r.doc_id: r.spans for r in pii.personal_data(documents(rows, "doc_id long, text string")).collect()}
    assert [tuple(s)[:3] for s in spans[1]] == [("ip", 23, 38), ("phone", 5, 22)]
    assert [(s.start, s.end, s.base) for s in spans[2]] == [(6, 25, False), (26, 45, False)]
    assert [(s.kind, s.start, s.end) for s in spans[4]] == [("email", 9, 51)] and spans[5] == []
    assert spans[3] == []
    for i, text in rows[5:]:
        assert [(s.kind, s.start, s.end) for s in spans[i]] == list(plain_spans(text))


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        values = list(range(1, n + 1))
        got = spark.createDataFrame([(values,)], "v array<long>").select(pii.running(F.col("v"))).first()[0]
        assert got == [sum(values[:i + 1]) for i in range(n)]


def test_reliabilities_are_found():
    rng, counts = random.Random(1), {}
    right = [0.95, 0.9, 0.8, 0.6, 0.5]
    for _ in range(20_000):
        truth = rng.random() < 0.3
        votes = tuple((1 if truth else -1) * (1 if rng.random() < p else -1) for p in right)
        counts[votes] = counts.get(votes, 0) + 1
    rows = [Row(kind="card", n=n, **dict(zip(pii.LABELERS, v))) for v, n in counts.items()]
    post = pii.reliabilities(rows)
    by = {pii.votes_of(r): p for r, p in zip(rows, post)}
    assert by[1, 1, 1, 1, 1] > 0.9 and by[-1, -1, -1, -1, -1] < 0.1
    assert by[1, 1, -1, -1, -1] > by[-1, -1, 1, 1, 1]  # the better labelers count for more
    assert abs(sum(r["n"] * p for r, p in zip(rows, post)) / 20_000 - 0.3) < 0.05
    weights = pii.logistic(rows, post)
    assert weights[len(pii.KINDS)] > weights[-1]


def test_native_plan_and_odd_rows(odd, empty, clashing):
    found = pii.digest(pii.personal_data(odd))
    plan = pii.candidates(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = found.collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 8 and {(r.base_sha256, r.spans) for r in rows} == {(nothing, "")}
    assert sorted(map(str, pii.digest(pii.personal_data(clashing)).collect())) == sorted(map(str, rows))
    assert pii.personal_data(empty).count() == 0
