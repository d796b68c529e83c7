"""Repair of the structure of conversations: the cheapest edits that leave `(system? (user assistant)+)?`.

Each row may be kept, given another role or deleted, and empty rows may be inserted. A path of edits is weighed by one
integer: its high digits are the cost, its low digits, LETTER_BITS wide, the letters of its edits in order, zeros filling
the end. The smaller integer is thus the cheaper path and, among equally cheap ones, that whose letters come first in
ASCII; zeros come before all letters. An edit put before a path shifts its letters by one digit and adds its cost and its
letter, so a dynamic program over a directed acyclic graph (rows by states of the pattern) needs integer minima only.

The states before and after a run of rows are few, so a run has a small matrix of such weights, and the matrices of
neighbouring runs multiply, minimum for sum. Conversations are cut into units of at most UNIT rows wherever range
partitions put them; matrices of units multiply level by level in groups of FAN, and the chosen states come back down.
So a conversation with a third of all rows needs no task of its own but for its digest, which is inherently sequential and
streams over the repaired texts of its units.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

#: Rows of a unit (a power of two), and units that are multiplied at once.
UNIT_BITS = 7
UNIT = 1 << UNIT_BITS
FAN = 64
LETTER_BITS = 3
LETTERS = "\0DIKR"
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5

#: States of the pattern: nothing yet, after system, after user, after assistant. What an initial leads to.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: What a row may be besides its initial: whole, to be deleted (blank or a duplicate), truncated.
WHOLE, SPENT, CUT = " ", "x", "t"
PAIRS = frozenset(("su", "ua", "au"))

Matrix = dict[tuple[int, int], tuple[int, str]]  # (state before, state after): cost, letters


class Edit(NamedTuple):
    after: int
    cost: int
    letters: str


def _inserts(state: int) -> list[Edit]:
    """No, one or two inserted rows; a third would repeat a state that a cheaper path has reached."""
    out, letters = [Edit(state, 0, "")], ""
    for _ in range(2):
        state = next(STEP[state, r] for r in ROLES if (state, r) in STEP)
        letters += "I"
        out.append(Edit(state, COSTS["I"] * len(letters), letters))
    return out


@cache
def _edits(initial: str, fault: str, state: int) -> list[Edit]:
    """What may happen from a state up to and with a row."""
    out = []
    for filled in _inserts(state):
        out.append(Edit(filled.after, filled.cost + COSTS["D"], filled.letters + "D"))
        if fault == SPENT:
            continue
        more = filled.cost + (TRUNCATED if fault == CUT else 0)
        if (filled.after, initial) in STEP:
            out.append(Edit(STEP[filled.after, initial], more + COSTS["K"], filled.letters + "K"))
        out += [Edit(STEP[filled.after, r], more + COSTS["R"], filled.letters + "R") for r in ROLES if (filled.after, r) in STEP]
    return out


def _digits(letters: str) -> int:
    out = 0
    for letter in letters:
        out = out << LETTER_BITS | LETTERS.index(letter)
    return out


def _letters(value: int, width: int) -> str:
    """The letters of left-aligned digits of `width` bits, up to the first zero."""
    octal = f"{value:0{width // LETTER_BITS}o}".rstrip("0") if width else ""
    return octal.translate({ord(str(n)): letter for n, letter in enumerate(LETTERS)})


def _before(cost: int, letters: str, digits: int, path: int, width: int) -> int:
    """The weight of a path with an edit (or a run of edits) put before it."""
    size, low = LETTER_BITS * len(letters), path & ((1 << width) - 1)
    return ((path >> width) + cost << width) + (digits << width - size) + (low >> size)


_KNOWN: dict[str, tuple[int, int]] = {}


def _swept(kinds: list[tuple[str, str]], best: dict[int, int], width: int) -> dict[int, int]:
    """From the weights of the paths behind a run of rows (initial, fault) those of the paths before it, by state."""
    low = (1 << width) - 1
    for kind in reversed(kinds):
        now: dict[int, int] = {}
        behind = {state: (weight >> width, weight & low) for state, weight in best.items()}
        for state in STATES:
            for after, cost, letters in _edits(*kind, state):
                if after in behind:
                    if letters not in _KNOWN:
                        _KNOWN[letters] = _digits(letters), LETTER_BITS * len(letters)
                    digits, size = _KNOWN[letters]
                    more, rest = behind[after]
                    weight = (more + cost << width) | (digits << width - size) | (rest >> size)
                    if state not in now or weight < now[state]:
                        now[state] = weight
        best = now
    return best


def rows_matrix(kinds: list[tuple[str, str]], starts: tuple[int, ...] = STATES, ends: tuple[int, ...] = STATES) -> Matrix:
    """The cheapest edits of a run of rows (initial, fault) between each two states."""
    width = LETTER_BITS * 3 * len(kinds)
    out: Matrix = {}
    for end in ends:
        best = _swept(kinds, {end: 0}, width)
        out |= {(s, end): (best[s] >> width, _letters(best[s] & ((1 << width) - 1), width)) for s in starts if s in best}
    return out


def rows_repaired(kinds: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a whole conversation."""
    width = LETTER_BITS * (3 * len(kinds) + 2)
    closing = {s: min(_before(c, x, _digits(x), 0, width) for (a, e), (c, x) in _CLOSING.items() if a == s and e in ENDS) for s in STATES}
    best = _swept(kinds, closing, width)[START]
    return best >> width, _letters(best & ((1 << width) - 1), width)


def _digits_of(letters: str) -> int:
    """Digits of a long text at once."""
    return int(letters.translate({ord(letter): str(n) for n, letter in enumerate(LETTERS)}) or "0", 8)


def _weighed(parts: list[Matrix]) -> tuple[list[dict[tuple[int, int], tuple[int, str, int]]], int]:
    """Each part's cells with their digits, and a width that holds the letters of all parts."""
    width = LETTER_BITS * sum(max((len(letters) for _, letters in m.values()), default=0) for m in parts)
    return [{key: (cost, letters, _digits_of(letters)) for key, (cost, letters) in m.items()} for m in parts], width


def _suffixes(parts: list[dict[tuple[int, int], tuple[int, str, int]]], width: int, end: int) -> list[dict[int, int]]:
    """For each part, and behind the last, the weight of the best path from each state before it to the end."""
    out: list[dict[int, int]] = [{end: 0}]
    for part in reversed(parts):
        now: dict[int, int] = {}
        for (state, after), (cost, letters, value) in part.items():
            if after in out[-1]:
                weight = _before(cost, letters, value, out[-1][after], width)
                if state not in now or weight < now[state]:
                    now[state] = weight
        out.append(now)
    return out[::-1]


def product(parts: list[Matrix]) -> Matrix:
    """The matrix of neighbouring runs, integers again deciding everything."""
    weighed, width = _weighed(parts)
    out: Matrix = {}
    for end in STATES:
        for state, w in _suffixes(weighed, width, end)[0].items():
            out[state, end] = (w >> width, _letters(w & ((1 << width) - 1), width))
    return out


def route(parts: list[Matrix], start: int, end: int) -> list[int]:
    """The states before, between and behind the parts on the best path."""
    weighed, width = _weighed(parts)
    best, out = _suffixes(weighed, width, end), [start]
    for part, here, then in zip(weighed, best, best[1:], strict=False):
        out.append(next(
            after for (state, after), (cost, letters, value) in part.items()
            if state == out[-1] and after in then and _before(cost, letters, value, then[after], width) == here[state]
        ))
    return out


#: Rows inserted after the last one, and the two states in which a conversation may end taken as one.
_CLOSING: Matrix = {(s, e.after): (e.cost, e.letters) for s in STATES for e in reversed(_inserts(s))}
_END: Matrix = {(s, START): (0, "") for s in ENDS}


def finished(matrix: Matrix) -> tuple[int, str, int]:
    """(cost, letters, state behind the last row) of the best path through a whole conversation."""
    parts = [matrix, _CLOSING, _END]
    cost, letters = product(parts)[START, START]
    return cost, letters, route(parts, START, START)[1]


def applied(rows: list[tuple[str, str]], letters: str, state: int) -> list[str]:
    """`role:text` of what the edits make of rows (role, text), from a state of the pattern on."""
    out, left = [], iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = ROLES[next(r for r in ROLES if (state, r) in STEP)]
        state = STEP[state, role[:1]]
        out.append(f"{role}:{text}")
    return out


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text, lost) of rows, damaged by the CRC-32 of `conv_id:turn`: one in twenty each is lost
    (marked), emptied, stripped of its ends of sentences, repeated (copy 1), or given the role user. Nulls become one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", words("role").alias("role"), words("text").alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("lost"),
    )


_FIELDS = {
    **dict.fromkeys(("conv", "first", "last", "audit", "repaired_sha256", "piece"), "string"),
    **dict.fromkeys(("unit", "of", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"),
    **dict.fromkeys(("before", "after"), "int"),
    "matrix": "array<struct<before:int,after:int,cost:bigint,letters:string>>", "kinds": "array<string>", "rows": "array<struct<role:string,text:string>>",
}
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()),
    _FIELDS["matrix"]: pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])),
    _FIELDS["rows"]: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
}
#: Rows of a batch that are Python objects at once.
SLICE = 256


def _mapped(df: DataFrame, names: str, each: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows with these columns that a function makes of each row, a slice of a batch at a time."""
    columns = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _ARROW[_FIELDS[c]]) for c in columns])
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield pa.RecordBatch.from_pylist([out for row in batch.slice(at, SLICE).to_pylist() for out in each(row)], schema)

    return df.mapInArrow(run, ", ".join(f"{c} {_FIELDS[c]}" for c in columns))


def _cells(matrix: Matrix) -> list[dict]:
    return [{"before": a, "after": b, "cost": c, "letters": x} for (a, b), (c, x) in matrix.items()]


def _matrix(cells: list[dict]) -> Matrix:
    return {(c["before"], c["after"]): (c["cost"], c["letters"]) for c in cells}


def _crossed(ends: list[tuple[str, str]]) -> int:
    """Neighbouring (first initial, last initial) that no conversation has."""
    return sum(a[1] + b[0] not in PAIRS for a, b in itertools.pairwise(ends))


def _unit(row: dict) -> Iterator[dict]:
    """Faults, edges and matrix of a unit; of the only unit of a conversation the finished repair instead."""
    news, kinds = set(row["news"] or ()), []
    out = {"conv": row["conv"], "unit": row["unit"], "of": row["of"], "blank": 0, "duplicate": 0, "truncated": 0}
    for own in row["rows"]:
        fault = "blank" if not own["tail"] else "duplicate" if own["id"] not in news else "truncated" if own["tail"] not in ".!?" else None
        if fault:
            out[fault] += 1
        kinds.append((own["role"][:1], WHOLE if fault is None else CUT if fault == "truncated" else SPENT))
    out |= {"illegal": _crossed([(k[0], k[0]) for k in kinds]), "first": kinds[0][0], "last": kinds[-1][0]}
    if row["of"] == 1:
        cost, audit = rows_repaired(kinds)
        text = "\n".join(applied([(x["role"], x["text"]) for x in row["rows"]], audit, START))
        yield out | {"cost": cost, "audit": audit, "repaired_sha256": sha256(text.encode()).hexdigest()}
    else:
        yield out | {"matrix": _cells(rows_matrix(kinds)), "kinds": [fault + initial for initial, fault in kinds], "rows": [{c: x[c] for c in ("role", "text")} for x in row["rows"]]}


def _merged(row: dict) -> Iterator[dict]:
    """One unit of a group of neighbouring units."""
    own = row["own"]
    sums = {c: sum(u[c] for u in own) for c in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += _crossed([(u["first"], u["last"]) for u in own])
    yield sums | {
        "conv": row["conv"], "unit": row["group"], "of": row["of"], "first": own[0]["first"], "last": own[-1]["last"],
        "matrix": _cells(product([_matrix(u["matrix"]) for u in own])),
    }


def _solved(row: dict) -> Iterator[dict]:
    """The repair of a conversation whose units have become one: its states, and the rows inserted after its last one."""
    matrix = _matrix(row["matrix"])
    cost, audit, after = finished(matrix)
    more = len(audit) - len(matrix[START, after][1])
    yield {c: row[c] for c in ("conv", "unit", "blank", "duplicate", "truncated", "illegal")} | {
        "cost": cost, "audit": audit, "before": START, "after": after, "piece": "\n".join(applied([], "I" * more, after)) if more else None,
    }


def _routed(row: dict) -> Iterator[dict]:
    """The states before and after each unit of a group, given those of the group."""
    states = route([_matrix(u["matrix"]) for u in row["own"]], row["before"], row["after"])
    for u, (a, b) in zip(row["own"], itertools.pairwise(states), strict=True):
        yield {"conv": row["conv"], "unit": u["unit"], "before": a, "after": b}


def _piece(row: dict) -> Iterator[dict]:
    """The repaired rows of a unit as one text."""
    kinds = [(k[1:], k[:1]) for k in row["kinds"]]
    letters = rows_matrix(kinds, (row["before"],), (row["after"],))[row["before"], row["after"]][1]
    lines = applied([(x["role"], x["text"]) for x in row["rows"]], letters, row["before"])
    if lines:
        yield {"conv": row["conv"], "unit": row["unit"], "piece": "\n".join(lines)}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a conversation of pieces that come in order; only a running digest is held."""
    conv, running = None, None
    for batch in batches:
        for name, piece in zip(batch.column("conv"), batch.column("piece"), strict=True):
            name, piece = name.as_py(), piece.as_py().encode()
            if name == conv:
                running.update(b"\n" + piece)
                continue
            if conv is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])
            conv, running = name, sha256(piece)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])


def _repair_long(units: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations with several units."""
    faults = ["blank", "duplicate", "truncated", "illegal"]
    levels, now, done = [], units, None
    while True:  # up: one unit of each FAN, until a conversation has one
        own = F.struct("unit", *faults, "first", "last", "matrix")
        group = F.expr(f"unit div {FAN}").alias("group")
        grouped = saved(now.groupBy("conv", group).agg(F.ceil(F.max("of") / FAN).alias("of"), F.sort_array(F.collect_list(own)).alias("own")))
        levels.append(grouped)
        now = saved(_mapped(grouped, "conv unit of blank duplicate truncated illegal first last matrix", _merged))
        solved = _mapped(now.where("of = 1"), "conv unit blank duplicate truncated illegal cost audit before after piece", _solved)
        done = solved if done is None else done.union(solved)
        now = now.where("of > 1")
        if now.isEmpty():
            break
    done = saved(done)
    states = None
    for grouped in reversed(levels):  # down: the states of each unit
        tops = done.select("conv", F.col("unit").alias("group"), "before", "after")
        ends = grouped.where("of = 1").join(tops, ["conv", "group"])
        if states is not None:
            ends = ends.unionByName(grouped.where("of > 1").join(states.withColumnRenamed("unit", "group"), ["conv", "group"]))
        states = saved(_mapped(ends, "conv unit before after", _routed))
    pieces = _mapped(units.select("conv", "unit", "kinds", "rows").join(states, ["conv", "unit"]), "conv unit piece", _piece)
    last = done.where("piece IS NOT NULL").select("conv", F.lit((1 << 63) - 1).alias("unit"), "piece")
    digests = pieces.union(last).repartition("conv").sortWithinPartitions("conv", "unit").mapInArrow(_digest, "conv string, repaired_sha256 string")
    return done.join(digests, "conv", "left").select("conv", *faults, "cost", "audit", F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id of rows.

    Rows are taken by turn, nulls first; rows of equal turn by role, then by the digest of their text. An input with a
    column `lost` leaves out the rows marked there but not their conversation. A null conv_id is a conversation of its own,
    null roles and texts are one space; an empty role has no initial and suits no state. Rows that repeat others are rows.
    Columns beyond conv_id, turn, role, text, copy and lost are not read. No rows give no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    extra = {"copy": F.lit(0), "lost": F.lit(False)} | {c: F.col(c) for c in ("copy", "lost") if c in rows.columns}
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    every = rows.groupBy("conv_id").agg(F.lit(0).alias("none")).select("conv_id", conv)
    present = rows.where(~extra["lost"]).select(conv, F.col("turn").cast("long").alias("turn"), extra["copy"].alias("copy"), text("role"), text("text"))
    keys = ["conv", F.asc_nulls_first("turn"), "role", "digest", "copy"]
    present = present.withColumn("digest", F.unhex(F.sha2("text", 256)))
    placed = saved(present.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()).drop("copy"))
    # the units of a conversation in a partition are consecutive; `before` counts those of earlier partitions
    spot, part = F.shiftright("id", UNIT_BITS), F.shiftright("id", 33)
    runs = placed.groupBy("conv", part.alias("part")).agg(F.shiftright(F.min("id"), UNIT_BITS).alias("least"), F.shiftright(F.max("id"), UNIT_BITS).alias("most"))
    whole = Window.partitionBy("conv")
    count = F.col("most") - F.col("least") + 1
    before = F.coalesce(F.sum(count).over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv", "part", (before - F.col("least")).alias("shift"), F.sum(count).over(whole).alias("of"))
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("id").alias("id")).groupBy("conv", spot.alias("spot")).agg(F.collect_list("id").alias("news"))
    marks = (
        placed.select("conv", spot.alias("spot"), part.alias("part")).distinct().join(runs, ["conv", "part"])
        .select("conv", "spot", (F.col("spot") + F.col("shift")).alias("unit"), "of").join(firsts, ["conv", "spot"], "left")
    )
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1).alias("tail")
    units = placed.groupBy("conv", spot.alias("spot")).agg(F.sort_array(F.collect_list(F.struct("id", "role", "text", tail))).alias("rows"))
    names = "conv unit of blank duplicate truncated illegal first last matrix kinds rows cost audit repaired_sha256"
    units = saved(_mapped(units.join(marks, ["conv", "spot"]), names, _unit))
    done = units.where("of = 1").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    long = units.where("of > 1")
    if not long.isEmpty():
        done = done.union(_repair_long(long))
    turns = placed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(done, "conv", "left").join(turns, "conv", "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
