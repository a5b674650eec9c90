"""Shards of the text search, in this process: against brute force, with the work that they do for a query."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


def shard_of(T, rows):
    """The only shard of rows (id, text), and its arguments."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["id", "text"])
    (made,) = T._indexed([batch])
    return [c[0].as_py() for c in made.columns]


def bags_of(T, texts):
    return [h[s:e] for _, h, _, b, _ in T.bags(pa.array(texts, pa.string())) for s, e in zip(b, b[1:])]


def opened(T, rows, queries):
    asked = T.Asked(list(zip([i for i, _ in queries], bags_of(T, [t for _, t in queries]))))
    words = [(t or "").split() for _, t in rows]
    df = Counter(w for x in words for w in set(x))
    mean = sum(map(len, words)) / len(words)
    idf = {w: np.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    numbers = {int(h[0]): w for w, h in zip(df, bags_of(T, list(df)))}
    asked.idf = np.array([idf[numbers[int(h)]] for h in asked.terms])
    score = lambda q, x, c: sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in sorted(set(q)) if w in c)
    return T.Shard(*shard_of(T, rows), mean, asked), words, score


def corpus(n, seed):
    """Texts of two languages, with rare and common words, copies and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 90))
        rows.append((i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.3, size) % 400)))
    return [*rows, (None, rows[0][1]), (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1]), (7, "a1 a2")]


@pytest.mark.parametrize("block,dense,few,piece,steps,tile", [(8, 0.02, 2, 4, (0.3, 1.0), 4000), (64, 2.0, 8, 16, (1.0,), 1 << 21), (16, 0.0, 8, 16, (0.2, 0.6, 1.0), 500), (4, 0.01, 1, 2, (1.0,), 1)])
def test_shard(monkeypatch, block, dense, few, piece, steps, tile):
    from stanchion.llm import text_search as T

    for name, x in (("BLOCK", block), ("DENSE", dense), ("FEW", few), ("PIECE", piece), ("STEPS", steps), ("TILE", tile)):
        monkeypatch.setattr(T, name, x)
    rows = corpus(150, block)
    queries = [(i, t) for i, t in rows if i is not None and t and i % 5 == 0]
    shard, words, score = opened(T, rows, queries)
    for share in (0.0, 0.9, 1.0):  # of the k-th best score, as floor
        best = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        want = []
        for q, text in queries:
            s = [(i, score(text.split(), x, Counter(x))) for (i, _), x in zip(rows, words) if i is not None and i != q]
            want.append(sorted((x for x in s if x[1] > 0), key=lambda x: (-round(x[1], 9), x[0]))[:5])
        floors = np.array([share * x[4][1] if len(x) > 4 else 0.0 for x in want])
        shard.best(floors, best, 5)
        for (ids, scores), x in zip(best, want):
            assert ids.tolist() == [i for i, _ in x]
            assert np.allclose(scores, [s for _, s in x], atol=1e-9)


def test_shard_of_long_queries_adds_few_postings():
    """Where queries are whole texts that share their words, most postings go through a product and few are added one by one."""
    from stanchion.llm import text_search as T

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 200) % 3000)) for i in range(600)]
    queries = rows[::10]
    shard, words, _ = opened(T, rows, queries)
    held = [set(x) for x in words]
    met = sum(len(set(t.split()) & x) for _, t in queries for x in held)
    shard.best(np.zeros(len(queries)), [(np.empty(0, np.int64), np.empty(0))] * len(queries), 10)
    assert shard.single < met / 3


def test_scores_that_tie_go_by_id(spark):
    """Equal parts among other words add up to scores that differ in their last places only: the smaller id comes first."""
    from stanchion.llm.text_search import search

    rng = np.random.default_rng(1)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(rng.permutation([*common, *(f"x{i}y{j}" for j in range(60))]))) for i in range(60)] + [(100, " ".join(common))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [r.doc_id for r in search(df, df.filter("doc_id = 100"), 30).orderBy("rank").collect()]
    assert got == list(range(30))
