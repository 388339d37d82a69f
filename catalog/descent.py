"""Gradient descent as SQL text: full-batch steps of a softmax model and of a small MLP, one CTE after another."""

from __future__ import annotations

from .views import with_views


def softmax_steps(
    select: str, group: str, steps: int, lr: float, momentum: float = 0.0, decay: float = 0.0,
    opt: str = "sgd", away: dict[int, tuple[int, ...]] | None = None, features: int = 64, classes: int = 10,
) -> str:
    """``select`` over ``w0`` .. ``w<steps>`` (g, label, pos, w; position -1 is the bias) and ``loss1`` ..
    (g, loss before the step), for every value g of ``group``, from zero.

    ``away`` has the shards that a step does without.
    """
    parts = {
        "cells": f"""SELECT {group} AS g, shard_id, sample_id, label, pos, x FROM sample_cells
            UNION ALL SELECT {group}, shard_id, sample_id, label, -1, 1.0 FROM sample_cells WHERE pos = 0""",
        "w0": f"""SELECT g, label, pos, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
            FROM (SELECT DISTINCT g FROM cells), (SELECT CAST(unnest(range({classes})) AS INTEGER) AS label),
            (SELECT CAST(unnest(range(-1, {features})) AS INTEGER) AS pos)""",
    }
    for k in range(1, steps + 1):
        out = ", ".join(map(str, (away or {}).get(k, ())))
        parts[f"c{k}"] = f"SELECT * FROM cells{f' WHERE shard_id NOT IN ({out})' if out else ''}"
        parts[f"s{k}"] = f"""SELECT c.g, c.sample_id, c.label AS y, w.label AS k, sum(c.x * w.w) AS s
            FROM c{k} c JOIN w{k - 1} w ON w.g = c.g AND w.pos = c.pos GROUP BY ALL"""
        parts[f"p{k}"] = f"""SELECT g, sample_id, y, k, e / sum(e) OVER (PARTITION BY g, sample_id) AS p
            FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY g, sample_id)) AS e FROM s{k})"""
        parts[f"loss{k}"] = f"SELECT g, avg(-ln(p)) AS loss, count(*) AS n FROM p{k} WHERE k = y GROUP BY g"
        parts[f"g{k}"] = f"""SELECT p.g, p.k AS label, c.pos, sum((p.p - CAST(p.k = p.y AS INTEGER)) * c.x) / any_value(l.n) AS d
            FROM p{k} p JOIN c{k} c ON c.g = p.g AND c.sample_id = p.sample_id JOIN loss{k} l ON l.g = p.g GROUP BY ALL"""
        d = f"(g.d + {decay} * w.w)"
        if opt == "adam":
            m, v = f"(0.9 * w.m + 0.1 * {d})", f"(0.999 * w.v + 0.001 * {d} * {d})"
            step = f"{lr} * ({m} / (1 - pow(0.9::DOUBLE, {k}))) / (sqrt({v} / (1 - pow(0.999::DOUBLE, {k}))) + 1e-8)"
        else:
            m, v = f"({momentum} * w.m + {d})", "w.v"
            step = f"{lr} * {m}"
        parts[f"w{k}"] = f"""SELECT w.g, w.label, w.pos, w.w - {step} AS w, {m} AS m, {v} AS v
            FROM w{k - 1} w JOIN g{k} g ON g.g = w.g AND g.label = w.label AND g.pos = w.pos"""
    return _chain("sample_cells", parts, select)


FLAT = "SELECT g, list(w ORDER BY pos < 0, label, pos) AS weights FROM {} GROUP BY g"


def mlp_step(select: str, hidden: int, lr: float, features: int = 64, classes: int = 10) -> str:
    """``select`` over ``stepped`` (g, i, w): a shard's model after one full batch, without dropout, from
    weights ``sin(i) / 10``, where i is the place in the flat model."""
    second = hidden * features + hidden
    size = second + classes * hidden + classes
    parts = {
        "cells": """SELECT shard_id AS g, sample_id, label, pos, x FROM sample_cells
            UNION ALL SELECT shard_id, sample_id, label, -1, 1.0 FROM sample_cells WHERE pos = 0""",
        "start": f"SELECT CAST(unnest(range({size})) AS INTEGER) AS i, sin(i) / 10 AS w",
        "u": f"""SELECT w, CASE WHEN i < {hidden * features} THEN i // {features} ELSE i - {hidden * features} END AS h,
            CASE WHEN i < {hidden * features} THEN i % {features} ELSE -1 END AS pos FROM start WHERE i < {second}""",
        "o": f"""SELECT w, CASE WHEN i < {second + classes * hidden} THEN (i - {second}) // {hidden}
            ELSE i - {second + classes * hidden} END AS k,
            CASE WHEN i < {second + classes * hidden} THEN (i - {second}) % {hidden} ELSE -1 END AS h
            FROM start WHERE i >= {second}""",
        "act": """SELECT c.g, c.sample_id, c.label, u.h, greatest(sum(c.x * u.w), 0) AS a
            FROM cells c JOIN u ON u.pos = c.pos GROUP BY ALL
            UNION ALL SELECT g, sample_id, label, -1, 1.0 FROM cells WHERE pos = -1""",
        "s": "SELECT a.g, a.sample_id, a.label, o.k, sum(a.a * o.w) AS s FROM act a JOIN o ON o.h = a.h GROUP BY ALL",
        "n": "SELECT g, count(DISTINCT sample_id) AS n FROM cells GROUP BY g",
        "d": """SELECT g, sample_id, k, e / sum(e) OVER (PARTITION BY g, sample_id) - CAST(k = label AS INTEGER) AS d
            FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY g, sample_id)) AS e FROM s)""",
        "go": f"""SELECT d.g, CASE WHEN a.h < 0 THEN {second + classes * hidden} + d.k ELSE {second} + d.k * {hidden} + a.h END AS i,
            sum(d.d * a.a) / any_value(n.n) AS grad
            FROM d JOIN act a ON a.g = d.g AND a.sample_id = d.sample_id JOIN n ON n.g = d.g GROUP BY ALL""",
        "back": """SELECT d.g, d.sample_id, o.h, sum(d.d * o.w) AS b FROM d JOIN o ON o.k = d.k AND o.h >= 0
            JOIN act a ON a.g = d.g AND a.sample_id = d.sample_id AND a.h = o.h AND a.a > 0 GROUP BY ALL""",
        "gu": f"""SELECT b.g, CASE WHEN c.pos < 0 THEN {hidden * features} + b.h ELSE b.h * {features} + c.pos END AS i,
            sum(b.b * c.x) / any_value(n.n) AS grad
            FROM back b JOIN cells c ON c.g = b.g AND c.sample_id = b.sample_id JOIN n ON n.g = b.g GROUP BY ALL""",
        "stepped": f"""SELECT n.g, s.i, s.w - {lr} * coalesce(q.grad, 0) AS w FROM start s CROSS JOIN n
            LEFT JOIN (SELECT * FROM go UNION ALL SELECT * FROM gu) q ON q.g = n.g AND q.i = s.i""",
    }
    return _chain("sample_cells", parts, select)


def _chain(view: str, parts: dict[str, str], select: str) -> str:
    rest = ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts.items())
    return f"{with_views('', view).rstrip()}, {rest} {select}"
