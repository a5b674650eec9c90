"""DuckDB SQL fragments that the oracles are put together from."""

from __future__ import annotations

from . import carriers as C

BOXES, WORKERS, TRACKS, SCORES = (C.duck(x) for x in (C.BOXES, C.WORKERS, C.TRACKS, C.SCORES))


def inter(a: str, b: str) -> str:
    w = f"(least({a}xc + {a}w / 2, {b}xc + {b}w / 2) - greatest({a}xc - {a}w / 2, {b}xc - {b}w / 2))"
    h = f"(least({a}yc + {a}h / 2, {b}yc + {b}h / 2) - greatest({a}yc - {a}h / 2, {b}yc - {b}h / 2))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"


def contain(a: str, b: str) -> str:
    return f"(CASE WHEN {a}w * {a}h > 0 THEN {inter(a, b)} / ({a}w * {a}h) ELSE 0 END)"


def iou(a: str, b: str) -> str:
    union = f"({a}w * {a}h + {b}w * {b}h - {inter(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN {inter(a, b)} / {union} ELSE 0 END)"


def anchor(i: str, cls: str, p: str) -> str:
    share = f"(CASE {cls} WHEN 2 THEN 0.35::DOUBLE WHEN 1 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END)"
    dx, dy = f"({i}xc - {p}xc)", f"({i}yc - ({p}yc - {p}h / 2 + {share} * {p}h))"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) / sqrt({p}w * {p}w + {p}h * {p}h))"


#: Candidates of the association, and the greedy fold over them.
CANDIDATES = f"""
boxes AS ({BOXES}),
cand AS (
  SELECT i.image_id, i.box_idx AS item, p.box_idx AS person, i.cls, {contain("i.", "p.")} AS score, {anchor("i.", "i.cls", "p.")} AS dist
  FROM boxes i JOIN boxes p ON i.image_id = p.image_id AND i.cls IN (1, 2) AND p.cls = 0 WHERE {contain("i.", "p.")} >= 0.8)
"""


def fold(source: str, key: str, order: str, fields: list[str], clash: str) -> str:
    """(key, fields) of the rows taken; clash compares y (taken) with x (next)."""
    row = ", ".join(f"'{f}': {f}" for f in fields)
    kinds = ", ".join(f'"{f}" BIGINT' for f in fields)
    taken = ", ".join(f"t.{f}::{'INT'} AS {f}" for f in fields)
    return f"""
  SELECT {key}, {taken} FROM (
    SELECT {key}, unnest(list_reduce(list([{{{row}}}]::STRUCT({kinds})[] ORDER BY {order}),
      lambda acc, n: CASE WHEN len(list_filter(acc, lambda y: {clash})) > 0 THEN acc ELSE list_concat(acc, n) END)) AS t
    FROM {source} GROUP BY {key})"""


BOUND = f"""{CANDIDATES},
bound AS ({fold("cand", "image_id", "score DESC, dist, item, person", ["item", "person", "cls"], "y.item = n[1].item OR (y.person = n[1].person AND y.cls = n[1].cls)")})
"""

#: Predictions are boxes of a confidence of 25 or more.
MATCHED = f"""
workers AS ({WORKERS}),
people AS (SELECT image_id, box_idx AS person, xc, yc, w, h FROM ({BOXES}) WHERE cls = 0 AND conf >= 25),
mcand AS (
  SELECT w.image_id, w.worker, p.person, {iou("p.", "w.")} AS score FROM workers w JOIN people p ON w.image_id = p.image_id WHERE {iou("p.", "w.")} >= 0.5),
matched AS ({fold("mcand", "image_id", "score DESC, worker, person", ["worker", "person"], "y.worker = n[1].worker OR y.person = n[1].person")})
"""
