"""Repair of conversations against brute force: every path of short ones, plain comparison of (cost, letters) for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cohortine.llm import conversations as c

FITS = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """(conv_id, turn, role, text) after damage, in table order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def offers(row, fault):
    """(cost, letter, role after) of what may become of a row."""
    yield 2, "D", None
    if fault not in ("blank", "duplicate"):
        more = 5 if fault == "truncated" else 0
        yield more, "K", row[2]
        yield more + 1, "R", "user"
        yield more + 1, "R", "assistant"


def every_path(rows, faults):
    """The best of all edits with at most two inserted rows in each place."""
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    for choice in itertools.product(*(list(offers(r, f)) for r, f in zip(rows, faults, strict=True))):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            lines = [(g, "") for g in filled[0]]
            cost, audit = 5 * len(filled[0]), "I" * len(filled[0])
            for row, (price, letter, role), more in zip(rows, choice, filled[1:], strict=True):
                cost, audit = cost + price + 5 * len(more), audit + letter + "I" * len(more)
                lines += ([(role, row[3])] if role is not None else []) + [(g, "") for g in more]
            if FITS.match("".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def by_text(rows, faults):
    """The same by plain comparison of (cost, letters), a step at a time."""
    def grow(found):
        for _ in range(3):
            for have, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    put(found, have + role[0], cost + 5, audit + "I", lines + [f"{role}:"])

    def put(found, initials, cost, audit, lines):
        state = "s" if initials == "s" else "" if not initials else "u" if re.match(r"s?(ua)*u\Z", initials) else "a" if re.match(r"s?(ua)+\Z", initials) else None
        short = {"s": "s", "": "", "u": "u", "a": "ua"}.get(state)
        if short is not None and (short not in found or (cost, audit) < found[short][:2]):
            found[short] = (cost, audit, lines)

    found = {"": (0, "", [])}
    grow(found)
    for row, fault in zip(rows, faults, strict=True):
        now = {}
        for have, (cost, audit, lines) in found.items():
            for price, letter, role in offers(row, fault):
                if role is None or role:
                    put(now, have + (role or "")[:1], cost + price, audit + letter, lines + ([f"{role}:{row[3]}"] if role else []))
        grow(now)
        found = now
    best = min((v for k, v in found.items() if k in ("", "ua")), key=lambda v: v[:2])
    return best[0], best[1], "\n".join(best[2])


def expected(rows, solve=by_text):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, turns = faults_of(own), [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit, text = solve(own, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def some_rows(rnd, convs, longest, roles=("system", "user", "assistant", "assistant", "user", "tool", None, "")):
    out = []
    for conv in convs:
        for turn in range(rnd.randint(1, longest)):
            text = rnd.choice(["Yes.", "No!", "a b", "  ", "", None, "end. \t", f"t{rnd.random()}.", f"u{rnd.random()}?", f"é{rnd.random()}."])
            out.append((conv, None if rnd.random() < 0.05 else turn * (2 if rnd.random() < 0.1 else 1), rnd.choice(roles), text))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS unit", "'x' AS conv", "2 AS id")
    return {r[0]: tuple(r)[1:] for r in c.repair(c.damage(df)).collect()}


def test_against_plain_comparison(spark):
    rnd = random.Random(7)
    rows = some_rows(rnd, [None, *range(150)], 14)
    rows += [(n, 0, "user", "Hello.") for n in range(500, 560)]  # some of them are lost wholly
    assert run(spark, rows) == expected(rows)


def test_against_every_path(spark):
    rnd = random.Random(11)
    rows = some_rows(rnd, range(25), 3)
    rows = [r for r in rows if r[2] != ""]
    assert run(spark, rows) == expected(rows, every_path)


@pytest.mark.parametrize("fan", [2, 64])
def test_units_of_long_conversations_multiply(spark, monkeypatch, fan):
    monkeypatch.setattr(c, "FAN", fan)
    rnd = random.Random(3)
    rows = some_rows(rnd, range(3), 10) + [(9, t, rnd.choice(["user", "assistant", "system"]), f"{t}{rnd.choice('.!x')}") for t in range(1500)]
    rows += [(10, None, "assistant", f"copy{n % 3}.") for n in range(400)] + [(11, t, "user", "") for t in range(300)]
    assert run(spark, rows) == expected(rows)


def test_nothing(spark):
    assert run(spark, []) == {}


def test_weights_order_as_cost_and_letters():
    rnd = random.Random(5)
    for _ in range(300):
        kinds = [(rnd.choice("suaox"), rnd.choice([c.WHOLE, c.SPENT, c.CUT])) for _ in range(rnd.randint(0, 7))]
        cut = rnd.randint(0, len(kinds))
        parts = [c.rows_matrix(kinds[:cut]), c.rows_matrix(kinds[cut:])]
        assert c.product(parts) == c.rows_matrix(kinds)
        cost, letters, after = c.finished(c.rows_matrix(kinds))
        assert c.rows_repaired(kinds) == (cost, letters)
        assert c.route([*parts, c._CLOSING, c._END], c.START, c.START)[2] == after
        assert letters.replace("I", "").count("K") <= len(kinds) and len(letters.replace("I", "")) == len(kinds) and cost >= 0
