"""The Merkle manifest against a plain recomputation and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortine.llm import merkle, merkle_sql
from cohortine.llm.scratch import folder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, rank string, total int, leaf int, digest int, `a.b` int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """The root above digests, and for each its siblings left and right level by level."""
    paths, spots = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, at in zip(paths, spots, strict=True):
            run = at // 16 * 16
            path.append((level[run:at], level[at + 1 : run + 16]))
        spots = [at // 16 for at in spots]
        level = [h("".join(level[at : at + 16])) for at in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5]))) for s in sources}
    trees = {s: climb([leaf(r[:5]) for r in own[s]]) for s in sources}
    root, over = climb([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, over, strict=True):
        subroot, paths = trees[s]
        for r, path in zip(own[s], paths, strict=True):
            whole = path + above
            node, text = leaf(r[:5]), r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                node = leaf((*r[:4], "".join(x.lower() if "A" <= x <= "Z" else x for x in text)))
            for left, right in whole:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join(d for left, right in whole for d in left + right))
            out.append((r[0], leaf(r[:5]), subroot, root, proof, node, node == root))
    return out


def proofs(spark, rows, depth=merkle.DEPTH):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA)
    path = folder(spark)
    text = {"text": merkle.ascii_lower(F.col("text"))}
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_digest([text.get(c, F.col(c)) for c in merkle.LEAF_COLUMNS]))
    merkle.write(docs, path, shown, depth=depth)
    return [tuple(r) for r in merkle.proofs(spark, path).collect()]


def some(n, source, rnd):
    return [(rnd.randint(0, 10 * n), source, rnd.choice(["en", None]), rnd.randint(0, 9), rnd.choice([None, "", "Ä Text", "plain", f"No {rnd.random()}"])) for _ in range(n)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_proofs(spark, depth):
    rnd = random.Random(depth)
    rows = [(1, None, None, None, None)] + some(17, "b", rnd) + some(600, "B", rnd) + some(16, "ä", rnd) + some(1, "", rnd) + [(5, "b", "x", 1, "Same")] * 3
    rows += [(None, "b", "x", 1, "Same"), (None, "b", "x", 1, "Other")] + [r for n in range(20) for r in some(2, f"s{n}", rnd)]
    assert order(proofs(spark, rows, depth)) == order(expected(rows))


def test_one_group_one_row_none(spark):
    rows = [(3, "a", "x", 1, "Text")]
    assert proofs(spark, rows) == expected(rows)
    assert proofs(spark, []) == []


def test_several_rounds_with_blocks_of_production_size(spark):
    rows = [(n, "hot", None, n, f"Text {n}") for n in range(4096 * 2 + 1)] + [(n, None, None, n, "x") for n in range(30)]
    assert order(proofs(spark, rows)) == order(expected(rows))


def test_sql_gives_the_same_rows():
    rnd = random.Random(9)
    rows = some(300, "b", rnd) + some(1, None, rnd) + some(33, "ä", rnd)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert order(con.execute(merkle_sql.manifest_sql()).fetchall()) == order(expected(rows))


def test_addresses_fill_the_tree_and_keep_subtrees_together():
    for height in range(1, 5):
        places = np.concatenate([merkle.address(height, d, np.arange(16**d)) for d in range(height)])
        assert sorted(places.tolist()) == list(range(merkle.size(height)))
    # below the upper half each subtree is one stretch, its root first
    root = merkle.address(4, 2, np.arange(256))
    for k in (0, 7, 255):
        below = merkle.address(4, 3, np.arange(16 * k, 16 * k + 16))
        assert below.tolist() == list(range(root[k] + 1, root[k] + 17))
