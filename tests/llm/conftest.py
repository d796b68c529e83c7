import random

import pytest

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, id string, drops int, part int, token double"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(["ka", "lo", "mi", "te", "ru", "sé"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared lines and passages, licences, and every awkward kind of row."""
    rnd = random.Random(5)
    out, n = [], 0

    def add(text, doc_id=..., lang="xx"):
        nonlocal n
        out.append((n if doc_id is ... else doc_id, text, lang, "s", None if text is None else len(text), "k", 1, "i", 2, 3, 0.5))
        n += 1

    lines = [sentence(rnd, 9) for _ in range(6)]
    passage = " ".join(sentence(rnd, 12) for _ in range(5))
    for i in range(30):
        body = [" ".join(sentence(rnd, rnd.randint(3, 12)) for _ in range(rnd.randint(1, 4))) for _ in range(4)]
        if i % 3 == 0:
            body.insert(1, rnd.choice(lines))
        if i % 5 == 0:
            body.append(passage)
        add("\n".join(body))
    base = [w for w in sentence(rnd, 60)[:-1].split()]
    for i in range(90):  # near copies of one text, each with a word of its own
        copy = list(base)
        copy[i % len(base)] = f"eigen{i}"
        add(" ".join(copy))
    short = [w for w in sentence(rnd, 40)[:-1].split()]
    for i in range(90):  # the same below the size that indexes combinations
        add(" ".join(short[:39] + [f"x{i}"]))
    for _ in range(5):
        add(" ".join(base))
    add("One two three.\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.")
    add("mit license mit license\napache\nlicense <|endoftext|> x")
    for text in (None, "", "   \n \t\n", "...!!!", "a", "A b", "a\x00b c\x1fd é", "x" * 5000, "0 1 2"):
        add(text)
    add(" ".join(sentence(rnd, 8) for _ in range(3000)))
    out += [out[3], out[3], (7, "another text for a known document", None, None, None, None, None, None, None, None, None)]
    out.append((None, "no id here", None, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None, None))
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    """Texts of each doc_id."""
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault(r[0], []).append(r[1])
    return out
