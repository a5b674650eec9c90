"""Jaccard join, components, searches, mixing, LM scores and the pipeline: against brute force, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, comp long, n long, k1 long, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, s) for i, t, s in rows], SCHEMA)


def near_copies(seed=4, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    line = " ".join(f"common{j}" for j in range(9))
    for g in range(groups):
        n = rng.choice([1, 3, 6, 12, 40, 120])
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 6, 60 if g == 3 else 4])):
            words = list(base)
            for _ in range(rng.randint(0, max(0, n // 25) + (n > 20) * 3)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            text = " ".join(words)
            rows.append((i, (line + " " + text if rng.random() < 0.4 else text).replace("w", rng.choice("wW")), f"s{i % 3}"))
            i += 1
    rows += [(i, None, "s0"), (i + 1, "", None), (i + 2, " \t", "s0"), (i + 3, "alone", "s1"), (i + 4, "ALONE", "s1"), (i + 5, line, "s2"), (i + 6, line, "s2"), (i + 7, "x y " * 20_000, "s2")]
    rng.shuffle(rows)
    return rows


def linked(rows, k=5, num=75, den=100):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,piece,cell", [(4, 500_000, 4096), (5, 500_000, 4096), (6, 300, 5), (7, 300, 2)])
def test_jaccard_join(spark, monkeypatch, seed, piece, cell):
    from stanchion.llm import jaccard_join as J

    monkeypatch.setattr(J, "PIECE", piece)
    monkeypatch.setattr(J, "CELL", cell)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs_of(spark, rows).repartition(3)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("cell,items", [(4096, 2_000_000), (7, 2_000_000), (4096, 500)])
def test_left_over_groups(spark, monkeypatch, cell, items):
    """Stars around one member leave a group in parts; the comparison of what is left over must find the rest, in one cell or in many."""
    from stanchion.llm import jaccard_join as J

    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "ITEMS", items)
    rng = random.Random(9)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(100)] = f"e{rng.randint(0, 30)}"
        rows.append((i, " ".join(words), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs_of(spark, rows)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("seed,cell", [(4, 4096), (6, 3)])
def test_every_link(spark, monkeypatch, seed, cell):
    """Links between different sets and each document's number of links, against all pairs."""
    from stanchion.llm import jaccard_join as J

    monkeypatch.setattr(J, "CELL", cell)
    rows, rng = near_copies(seed), random.Random(seed)
    for i in range(30):
        words = [f"w{j}" for j in range(100)]
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(100)] = f"e{rng.randint(0, 30)}"
        rows.append((10_000 + i, " ".join(words), "s"))
    sets = {}
    for i, t, _ in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    name = {v: min(i for i in sets if sets[i] == v) for v in sets.values()}
    met = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    pairs, told = J.links(docs_of(spark, rows).repartition(3))
    want = {(name[a], name[b]) for a in name for b in name if name[a] < name[b] and met(a, b)}
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want) > 10
    got = {r.doc_id: (r.class_id, r.n_links) for r in told.collect()}
    assert got == {i: (name[v] if v else None, sum(bool(met(v, u)) for j, u in sets.items() if j != i)) for i, v in sets.items()}
    pairs, told = J.links(docs_of(spark, rows).limit(0))
    assert pairs.count() == told.count() == 0


def test_jaccard_odd_rows(spark):
    from stanchion.llm.jaccard_join import jaccard_join

    t = "a b c d e f g"
    rows = [(None, t, "s"), (3, t, "s"), (3, "other words are here now", "s"), (8, t, "s"), (9, "Other words are here now", "s")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join(docs_of(spark, rows)).collect())
    assert got == [(False, 3, 1, 3), (False, 3, 3, 3), (False, 8, 3, 3), (False, 9, 1, 3), (True, 0, 3, None)]
    top = 2**63 - 1
    ends = [(top, t, "s"), (None, t, "s"), (7, t, "s"), (top - 1, "one two three", "s"), (-(2**63), "one two three", "s")]
    assert {(r.doc_id, r.component_id) for r in jaccard_join(docs_of(spark, ends)).collect()} == {(top, 7), (7, 7), (None, None), (top - 1, -(2**63)), (-(2**63), -(2**63))}
    assert jaccard_join(docs_of(spark, rows).limit(0)).count() == 0


def test_blocks_agree():
    """For random linked pairs of sets, some token of the larger's band is in both selections whatever is left out of the most frequent."""
    from stanchion.llm.jaccard_join import tokens

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 8, 13, 30, 100, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, len(a) // 7 + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, len(a) // 7 + 1)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            found = False
            for x, sx in tokens(a, 75, 100):
                for y, sy in tokens(b, 75, 100):
                    order = lambda t: t[np.argsort(t)]  # noqa: E731  any one order will do
                    found |= bool(len(np.intersect1d(order(x)[: len(x) - sx], order(y)[: len(y) - sy])))
            assert found, n


@pytest.mark.parametrize("most", [1000, 5])
def test_components(spark, most):
    from stanchion.llm._base import keep
    from stanchion.llm.components import components

    rng = random.Random(most)
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 15)] + [(rng.randint(200, 240), rng.randint(200, 240)) for _ in range(30)] + [(5, 5), (7, 6)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(keep(spark.createDataFrame(edges, "a long, b long"), "t"), most).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("block,steps", [(64, (0.1, 0.45, 1.0)), (4, (0.3, 1.0)), (2, (1.0,)), (1, (0.1, 0.2, 0.5, 1.0))])
def test_text_search(spark, monkeypatch, block, steps):
    import re

    from stanchion.llm import text_search as T

    monkeypatch.setattr(T, "SHARD_TERMS", 400)
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "STEPS", steps)
    monkeypatch.setattr(T, "QUERY_TERMS", 300)
    rows = near_copies(8)
    df = docs_of(spark, rows).repartition(3)
    got = defaultdict(list)
    for r in T.search(df, df.filter("doc_id % 3 = 0"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    bag = {i: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for i, t, _ in rows}
    n, length = len(bag), {i: sum(c.values()) for i, c in bag.items()}
    mean = sum(length.values()) / n
    df_ = Counter(w for c in bag.values() for w in c)
    for q in bag:
        if q % 3:
            continue
        s = {}
        for i, c in bag.items():
            v = sum(math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w in sorted(bag[q]) if w in c)
            if i != q and v > 0:
                s[i] = v
        want = sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        assert [round(x[1], 8) for x in got[q]] == [round(x[1], 8) for x in want]
        assert [x[0] for x in got[q]] == [x[0] for x in want]
    assert T.search(df.limit(0), df.limit(0)).count() == 0


def test_text_search_odd_rows(spark):
    from stanchion.llm.text_search import search

    top = 2**63 - 1
    rows = [(top, "red fox", "s"), (None, "red fox", "s"), (5, "red fox", "s"), (5, "red hen", "s"), (6, "Red", "s"), (7, None, "s"), (8, "", "s"), (9, "blue sea", "s")]
    df = docs_of(spark, rows)
    got = defaultdict(list)
    for r in search(df, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    # rows that share id 5 are its own; the null id neither asks nor answers; a shared id asks with its least text
    assert dict(got) == {top: [5, 6, 5], 5: [top, 6], 6: [5, 5, top]}
    ranked = search(df, df.filter("doc_id = 6")).orderBy("rank").collect()
    assert [r.rank for r in ranked] == [1, 2, 3] and len({r.score for r in ranked}) == 1


def test_vector_search(spark, monkeypatch):
    from stanchion.llm import vector_search as V

    monkeypatch.setattr(V, "SHARD", 300)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    x = centres[rng.integers(0, 6, 1200)] + 0.4 * rng.standard_normal((1200, 24))
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    odd = [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [1.0] * 3, 0), (5004, [None] + [1.0] * 23, 0), (None, rows[1][1], 0), (5100, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in V.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 50))
    hits = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        hits += len(set(want) & {i for i, _ in near})
        assert all(abs(d[i] - s) < 1e-12 for i, s in near) and near == sorted(near, key=lambda v: (v[1], v[0])) and len(near) == 10
    assert hits >= 0.9 * 10 * len(got) and [i for i, _ in got[50]] == [0] + list(range(51, 60))
    few = df.filter("vec_id < 3")
    assert V.search(few, few).count() == 6 and V.search(df.limit(0), df.limit(0)).count() == 0


def test_mixing(spark):
    from stanchion.llm import mixing as M

    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    rows += [(1000, None, "blank"), (1001, "a b", None), (1002, "", "hot"), (3, rows[3][1], "hot")]
    df = docs_of(spark, rows)
    w = {r.src: r for r in M.weights(df).collect()}
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    p = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    a = w["hot"].exponent
    z = sum(v**a for v in p.values())
    assert all(math.isclose(w[s].weight, p[s] ** a / z) for s in p) and w["blank"].weight == 0
    reps = {s: w[s].epochs + w[s].rest / w[s].tokens for s in p}
    assert min(reps.values()) >= 1 - 1e-6 and max(reps.values()) <= 4 + 1e-3
    out = M.allot(df).collect()
    assert len(out) == len(rows) and all(r.copies >= 1 for r in out)
    used = defaultdict(int)
    n = defaultdict(list)
    for i, t, s in rows:
        n[i].append(len((t or "").split()))
    for r in out:
        used[r.source] += r.copies * n[r.doc_id][0]
    for s in p:
        goal = w[s].epochs * w[s].tokens + w[s].rest
        assert goal - 81 <= used[s] <= goal
    mixed = M.mix(df, order=True)
    assert mixed.count() == sum(r.copies for r in out) and mixed.columns[:-2] == df.columns
    half = M.allot(df, budget=0.5 * sum(tokens.values()))
    assert half.filter("copies = 0").count() > 0
    assert M.allot(df.limit(0)).count() == 0 and M.mix(df.filter("doc_id = 1000")).count() == 1


@pytest.mark.parametrize("ids", [4_000_000, 10])
def test_lm_scores(spark, monkeypatch, ids):
    """Against exact counts, with the target's ids broadcast and joined; rows that share an id, null and very long rows among them."""
    from stanchion.llm import lm_score as L

    monkeypatch.setattr(L, "IDS", ids)
    rng = random.Random(6)
    words = [f"v{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 50))), "s") for i in range(150)] + [(500, None, "s"), (501, "", "s"), (502, "A a " * 30_000, "s")]
    rows += [(8, rows[3][1], "s"), (None, "v1 v2 v2", "s"), (None, None, "s")]
    df = docs_of(spark, rows).repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 150, 4)] + [(0,), (None,), (9999,)], "doc_id long")
    text = [(i, (t or "").translate(LOWER).split()) for i, t, _ in rows]
    pairs = [(i, list(zip(["<s>"] + t, t))) for i, t in text]
    size = len({x for _, t in text for x in t}) + 2

    def model(on):
        one, two, h = Counter(x for i, t in text if on(i) for x in t), Counter(x for i, p in pairs if on(i) for x in p), Counter(a for i, p in pairs if on(i) for a, _ in p)
        total = sum(one.values())
        return lambda a, b: -math.log((two[a, b] + L.MU * (one[b] + 1) / (total + size)) / (h[a] + L.MU))

    fb, ft = model(lambda i: True), model(lambda i: i is not None and i < 150 and i % 4 == 0)
    want = []
    for i, p in pairs:
        b, t = (sum(f(*x) for x in p) / len(p) if p else None for f in (fb, ft))
        want.append((-1 if i is None else i, len(p), *(round(x, 8) if p else None for x in (t, b, t - b if p else None))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    models = L.fit(df, good)
    for scored in (L.score(df, models), L.score(df.filter("true").select(*df.columns[::-1]), models)):  # the corpus itself, and as other rows
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, *(None if x is None else round(x, 8) for x in (r.loss_target, r.loss_background, r.score))) for r in scored.collect()]
        for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert x[:2] == y[:2] and all(u == v or abs(u - v) < 1e-7 for u, v in zip(x[2:], y[2:])), (x, y)
    assert L.score(df, L.fit(df.limit(0), good.limit(0))).count() == len(rows) and L.score(df.limit(0), models).count() == 0


def test_lm_counts_every_word_and_bigram(spark, monkeypatch):
    """More words than were once kept (60,000), in pieces of a few documents, against exact counts."""
    from stanchion.llm import lm_score as L

    monkeypatch.setattr(L, "PIECE", 20_000)
    rng = random.Random(8)
    texts = {i: [f"r{i}x{j}" if j % 3 else f"c{rng.randint(0, 30)}" for j in range(150)] for i in range(640)}
    texts |= {700: [], 701: texts[5][::-1], 702: texts[5] + texts[9]}
    df = docs_of(spark, [(i, " ".join(t) or None, "s") for i, t in texts.items()] + [(None, "c1 c2", "s")]).repartition(3)
    texts[None] = ["c1", "c2"]
    good = set(range(0, 640, 7)) | {702}
    got = {r.doc_id: r for r in L.score(df, L.fit(df, spark.createDataFrame([(i,) for i in good], "doc_id long"))).collect()}
    assert len(got) == len(texts) and len({x for t in texts.values() for x in t}) > 60_000
    size = len({x for t in texts.values() for x in t}) + 2
    pairs = {i: list(zip(["<s>"] + t, t)) for i, t in texts.items()}

    def model(ids):
        one, two = Counter(x for i in ids for x in texts[i]), Counter(x for i in ids for x in pairs[i])
        h, total = Counter(a for i in ids for a, _ in pairs[i]), sum(len(texts[i]) for i in ids)
        return lambda a, b: -math.log((two[a, b] + L.MU * (one[b] + 1) / (total + size)) / (h[a] + L.MU))

    fb, ft = model(list(texts)), model(good)
    for i, p in pairs.items():
        r = got[i]
        assert r.n_tokens == len(p) and (r.score is None) == (not p)
        if p:
            b, t = sum(fb(*x) for x in p) / len(p), sum(ft(*x) for x in p) / len(p)
            assert math.isclose(r.loss_background, b, rel_tol=1e-9) and math.isclose(r.loss_target, t, rel_tol=1e-9) and math.isclose(r.score, t - b, abs_tol=1e-9), i
    other = docs_of(spark, [(1, "never seen", "s")])
    unseen = L.score(other, L.fit(df.limit(0), spark.createDataFrame([], "doc_id long"))).first()
    assert unseen.n_tokens == 2 and math.isclose(unseen.loss_target, math.log(2)) and unseen.score == 0


def test_pipeline(spark, tmp_path):
    """Each stage against what it should do to its own input, over a small fixture."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    rng = random.Random(12)
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in near_copies(12)]
    n = max(r[0] for r in rows) + 1
    for j in range(300):
        bad = j % 6 == 0
        text = " ".join(rng.choice(["plain", "words", "of", "no", "harm"]) + str(rng.randint(0, 999)) for _ in range(30)) + (" bozo dimwit" if bad else "")
        rows.append((n + j, text, "en", "s1", len(text)))
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(n + j, int(j % 6 == 0)) for j in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    now, frames = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        frames.append(now)
    clean, distinct, cut, mixed, final = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    bad = {n + j for j in range(0, 300, 6)}
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert len(left & bad) <= 2 and {r[0] for r in rows} - bad <= left
    own = [(r.doc_id, r.text, r.source) for r in clean.collect()]
    assert {r.doc_id for r in distinct.collect()} == {i for i, (_, c) in linked(own).items() if i == c}
    assert cut.count() == distinct.count() and cut.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in cut.collect()}
    assert final.count() == mixed.count() and final.filter("not exact").count() == 0
    whole = P.run(spark, d)
    assert whole.exceptAll(final).count() == 0 and final.exceptAll(whole).count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, columns with names used inside, and an empty table, through all stages."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, comp long, _mix_n int, toxicity_score double, id long"
    long = "some words of a text that is long enough to be found again in another row of this table of texts " * 3
    texts = [(1, long, "s"), (2, long, None), (None, long, "s"), (None, None, None), (3, None, "t"), (4, "", "s"), (4, "short", "s"), (4, "short", "s"), (2**63 - 1, "x" * 5000, "t")]
    rows = [(i, t, None, s, None, "r", 1, 2, 0.25, 9) for i, t, s in texts]
    d = str(tmp_path)
    spark.createDataFrame([(1, 0), (3, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, given in (("odd", rows), ("none", [])):
        now = spark.createDataFrame(given, kind)
        for stage, f in P.STAGES:
            columns = now.columns
            f(spark, now, d).write.parquet(f"{d}/{name}_{stage}")
            now = spark.read.parquet(f"{d}/{name}_{stage}")
            assert stage == "sentencepiece" or now.columns == columns, stage
        assert now.filter("not exact").count() == 0
        if given:
            left = spark.read.parquet(f"{d}/{name}_near_duplicates")
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i, _, _ in texts if i != 2)
        else:
            assert now.count() == 0
