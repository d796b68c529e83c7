"""Personal data against the plain patterns, and what checksums and context words decide."""

import hashlib
import random
import re
import time

import pytest

from cohortine.llm import personal_data as p


def plain(text):
    """Base finds by the patterns as they are stated."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in re.sub("[^0-9]", "", m.group())][::-1]
        doubled = [sum(divmod(2 * d, 10)) if n % 2 else d for n, d in enumerate(digits)]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], p.BASE.index(s[2])))


def test_report(spark, docs, rows, empty):
    extra = [
        (None, "Mail a.b@c.de, a@b, x@y.z@q.r and 10.0.0.1 or 1.2.3.256"), (901, "ä +1 (555) 123-4567 😀 4111 1111 1111 1111 and 4111111111111112"),
        (901, "second row 1.2.3.4.5.6.7.8"), (902, ""), (903, "token = \"3c4226790abcdef012345\"; IBAN DE89 3704 0044 0532 0130 00"),
    ]
    df = docs.select("doc_id", "text", "token", "id").union(spark.createDataFrame([(*r, 0.5, "i") for r in extra], "doc_id long, text string, token double, id string"))
    texts = [(r[0], r[1]) for r in rows] + extra
    want = []
    for doc, text in texts:
        found = plain(text or "")
        told = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        want.append((doc, *(sum(k == kind for _, _, k in found) for kind in p.BASE), hashlib.sha256(told.encode()).hexdigest()))
    got = p.report(df).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    for r in got:
        base = {s for s in r.spans.split(",") if s.split(":")[0] in p.BASE}
        assert hashlib.sha256(",".join(s for s in r.spans.split(",") if s in base).encode()).hexdigest() == r.base_sha256 and 0 <= r.score <= 1
    assert {k for r in got if r.doc_id == 903 for k in re.findall("[a-z]+", r.spans)} == {"iban", "secret"}
    assert p.report(empty).count() == 0


def test_random_texts():
    rnd = random.Random(3)
    for _ in range(20000):
        text = "".join(rnd.choice("ab@.1 2+-()3٣é9%") for _ in range(rnd.randint(0, 60)))
        assert sorted(p.base_spans(text), key=lambda s: (s[0], p.BASE.index(s[2]))) == plain(text)


@pytest.mark.parametrize("unit", ["a", "1", "@a", "a@", "+1 (", "+1" + "(" * 99, "AB12", "1-", "a.b@c"])
def test_long_runs_take_linear_time(unit):
    started = time.thread_time()
    p.spans_of(unit * (500_000 // len(unit)))
    assert time.thread_time() - started < 10


def kinds(text):
    return [k for _, _, k, _ in p.spans_of(text)]


def test_checksums_confirm():
    assert p.luhn("4111111111111111") and not p.luhn("4111111111111112")
    assert p.mod97("DE89370400440532013000") and not p.mod97("DE88370400440532013000")
    assert kinds("pay to GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("pay to GB83 WEST 1234 5698 7654 32") == []


def test_context_decides():
    number = "a1b2c3d4e5f6a7b8c9d0"
    assert kinds(f"api_key: {number}") == ["secret"] and kinds(f"chapter {number}") == []
    assert kinds(f"commit key {number}") == []
    assert kinds("call 555-867-5309 now") == ["tel"] and kinds("part 555-867-5309 now") == []
    assert kinds("SSN 219-09-9999") == ["ssn"] and kinds("SSN 000-09-9999") == [] and kinds("219-09-9999") == []
    scores = [p.spans_of(t)[0][3] for t in ("card 4111111111111111", "4111111111111111", "order 4111111111111111")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3


def test_added_finds_never_overlap():
    found = p.spans_of("phone +1 (555) 123-4567, key = 1234567890123456abcdef, tel 555-867-5309")
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_redact(spark):
    df = spark.createDataFrame([(1, "to a@b.de or +1 (555) 123-4567.", "k"), (2, None, "k")], "doc_id long, text string, `a.b` string")
    assert [r.text for r in p.redact(df).orderBy("doc_id").collect()] == ["to [email] or [phone].", None]
