"""Pieces of SQL that the oracles share. Each is one or more common table expressions."""

from __future__ import annotations

from arcloom.sources.views import SQL_EDGES, SQL_FEATURES, SQL_NODES

BASE = f"WITH {SQL_EDGES}, {SQL_FEATURES}"
EDGES = f"WITH {SQL_EDGES}, {SQL_NODES}"
PLACES = "(VALUES (0), (1)) AS p(pos)"

#: Edges with one loop for every node, and the normalised weights of graph convolutions.
LOOPED = """lo AS (SELECT src, dst, w FROM e WHERE src <> dst UNION ALL SELECT id, id, coalesce(l.w, 1.0) FROM n LEFT JOIN (SELECT src, max(w) AS w FROM e WHERE src = dst GROUP BY src) l ON l.src = n.id)"""
GCN = LOOPED + """, dg AS (SELECT dst AS id, sum(w) AS d FROM lo GROUP BY dst), a AS (SELECT lo.src, lo.dst, CASE WHEN s.d > 0 THEN pow(s.d, -0.5) ELSE 0 END * lo.w * CASE WHEN t.d > 0 THEN pow(t.d, -0.5) ELSE 0 END AS w FROM lo LEFT JOIN dg s ON s.id = lo.src LEFT JOIN dg t ON t.id = lo.dst)"""
LAPLACIAN_SYM = """e0 AS (SELECT * FROM e WHERE src <> dst), od AS (SELECT n.id, coalesce(sum(e0.w), 0) AS d FROM n LEFT JOIN e0 ON e0.src = n.id GROUP BY n.id), lap AS (SELECT e0.src, e0.dst, -(CASE WHEN s.d > 0 THEN pow(s.d, -0.5) ELSE 0 END) * e0.w * CASE WHEN t.d > 0 THEN pow(t.d, -0.5) ELSE 0 END AS w FROM e0 JOIN od s ON s.id = e0.src JOIN od t ON t.id = e0.dst UNION ALL SELECT id, id, 1.0 FROM n)"""


def step(name: str, adjacency: str, features: str) -> str:
    """name(id, pos, v): the weighted sum over incoming edges."""
    return f"""{name} AS (SELECT n.id, p.pos, coalesce(sum(t.w * x.v), 0) AS v FROM n CROSS JOIN {PLACES} LEFT JOIN {adjacency} t ON t.dst = n.id LEFT JOIN {features} x ON x.id = t.src AND x.pos = p.pos GROUP BY n.id, p.pos)"""


def mix(name: str, parts: list[tuple[float, str]]) -> str:
    """name(id, pos, v): a weighted sum of feature tables."""
    union = " UNION ALL ".join(f"SELECT id, pos, {c!r} * v AS v FROM {t}" for c, t in parts)
    return f"{name} AS (SELECT id, pos, sum(v) AS v FROM ({union}) GROUP BY id, pos)"


def linear(name: str, features: str, weights: list[list[float]], bias: list[float] | None = None) -> str:
    bias = bias or [0.0] * len(weights[0])
    outs = " UNION ALL ".join(f"SELECT id, {o} AS pos, " + " + ".join(f"sum(CASE WHEN pos = {i} THEN v * {weights[i][o]!r} ELSE 0 END)" for i in range(len(weights))) + f" + {bias[o]!r} AS v FROM {features} GROUP BY id" for o in range(len(bias)))
    return f"{name} AS ({outs})"


def out(features: str) -> str:
    return f"SELECT id, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS v FROM {features}"
