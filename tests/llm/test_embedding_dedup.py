"""Embedding near-duplicates against all pairs, and odd rows."""

import math

import numpy as np
import pytest

from stanchion.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""
    ok = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) / np.abs(v).max() if good else None)
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    out = []
    for a, (i, _) in enumerate(rows):
        c = least.get(find(a))
        out.append((i, links[a], c, c is None or i == c))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], 1, 1.0) for i, v in rows], "vec_id long, embedding array<double>, n int, cls double").repartition(3)
    return sorted((tuple(r) for r in E.embedding_dedup(df, **kw).collect()), key=repr)


def made(n, dims=8, groups=9, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dims)) for i in range(n)]
    for g in range(groups):
        for k in range(rng.integers(1, 30)):
            rows.append((len(rows), rows[g][1] * rng.uniform(0.1, 9) + 0.05 * rng.standard_normal(dims)))
    rows += [(len(rows) + k, rows[0][1]) for k in range(60)]
    return [(i, v.tolist()) for i, v in rows]


ODD = [
    (None, None), (900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [math.nan]), (905, [math.inf] + [1.0] * 7),
    (906, [1e300] * 8), (907, [1e-300] * 8), (908, [1.0] * 8), (909, [1.0] * 5), (910, [2.0] * 5), (911, [0.0, 1.0]), (912, [-0.0, 1.0]),
    (5, [7.0, -7.0, 0, 0, 0, 0, 0, 0]), (5, [7.0, -7.0, 0, 0, 0, 0, 0, 0]), (5, [-7.0, 7.0, 0, 0, 0, 0, 0, 0]), (None, [0, 0, 0, 0, 0, 0, 3.0, -3.0]), (None, [0, 0, 0, 0, 0, 0, 3.0, -3.0]),
]


def test_one_window_holds_all_pairs_and_odd_rows(spark):
    rows = made(120) + ODD
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_small_windows_find_nearly_all_and_count_each_pair_once(spark):
    rows = made(700, groups=25, seed=8)
    want = {r[0]: r for r in brute(rows)}
    got = {r[0]: r for r in run(spark, rows, window=32, block_size=64)}
    assert all(got[i][1] <= want[i][1] for i in want)
    found, there = (sum(r[1] for r in x.values()) for x in (got, want))
    assert found >= 0.95 * there
    assert sum(got[i][2] != want[i][2] for i in want) <= 0.01 * len(want)


@pytest.mark.parametrize("n, least", [(100, 1), (50_000, 8), (10**9, 60)])
def test_passes_grow_slowly(n, least):
    assert least <= E.passes_for(n, 0.9) <= 3 * least
