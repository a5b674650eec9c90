"""License scan, toxicity, token output, pieces, substring dedup: against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, row string, items string, grp int"
VOCAB = [a + b for a in ("ka", "lo", "mi", "né", "pu", "ß", "日") for b in ("ra", "to", "x", "Zed", "9")]


def docs_of(spark, rows):
    """With columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "r", "i", 1) for i, t in rows], SCHEMA)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(VOCAB) for _ in range(45))
    rows = []
    for i in range(n):
        words = [rng.choice(VOCAB) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n\x0b "), (n + 4, "one"), (n + 5, "long " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


def test_substring_dedup(spark, empty):
    from stanchion.llm.substring_dedup import substring_dedup

    rows = corpus()
    got = {r.doc_id: r for r in substring_dedup(docs_of(spark, rows).repartition(5)).collect()}
    seen = set()
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), kept), i
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_odd_ids(spark):
    from stanchion.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{i}" for i in range(25))
    out = substring_dedup(docs_of(spark, [(None, text), (7, text), (7, text), (9, text), (9, "short")]), carry=["row"]).collect()
    left = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in out)
    assert left == [(False, 7, 25, 0), (False, 7, 25, 0), (False, 9, 1, 0), (False, 9, 25, 25), (True, 0, 25, 25)] and {r.row.row for r in out} == {"r"}


def test_sketch_loses_nothing():
    from stanchion.llm import _sketch

    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    h[2500:2600] = h[:100]
    blocks = {}
    batches = [b for a in (0, 2500) for b in [_sketch._emit([h[a : a + 2500]], _sketch.DEPTH)]]
    import pyarrow as pa

    table = pa.Table.from_batches(batches).sort_by("block").to_batches()
    for out in _sketch._merge(iter(table)):
        r = out.to_pylist()[0]
        blocks[r["block"]] = r["once"]
    on = _sketch.maybe_repeated(_sketch.Marks(blocks, _sketch.DEPTH), h)
    assert on[:100].all() and on[2500:2600].all() and on.sum() < 260


def test_license_scan(spark, empty):
    from stanchion.llm.license_scan import license_scan

    rows = corpus() + [
        (200, "Foo. Licensed under CC BY-NC 4.0. bar"),
        (201, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved. all RIGHTS reserved"),
        (202, "Licensed under the Apache License, Version 2.0."),
        (203, "the license of the apache version licensed under 2 0"),
        (None, "Released under the MIT License."),
    ]
    got = {r.doc_id: r for r in license_scan(docs_of(spark, rows).repartition(3)).collect()}
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in base.items():
            k = phrase.split()
            here = [s for s in range(len(w) - len(k) + 1) if w[s : s + len(k)] == k]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1
    assert got[200].labels == "cc-by,cc-by-nc-4.0" and got[201].labels == "gpl,gpl-3.0,reserved" and got[202].labels == "apache-2.0" and got[202].score == 1.0
    assert got[203].labels == "" and got[203].score == 0.0 and got[None].labels == "mit"
    assert license_scan(empty).count() == 0


def test_license_line_in_a_third_of_the_rows(spark):
    from stanchion.llm.license_scan import license_scan

    rows = [(i, f"prose {i} licensed under CC BY 4.0." if i % 3 == 0 else f"prose {i} of a row") for i in range(3900)]
    got = {r.doc_id: r for r in license_scan(docs_of(spark, rows).repartition(2)).collect()}
    assert all((r.labels, r.score) == (("cc-by,cc-by-4.0", 1.0) if i % 3 == 0 else ("", 0.0)) for i, r in got.items())
    assert [tuple(x) for x in got[3].spans] == [("cc-by-4.0", 2, 8, 1.0)]


@pytest.mark.parametrize("n", [1, 10, 3000])
def test_license_in_every_row(spark, n):
    """Labels do not depend on how large the corpus is, even where every file carries the licence."""
    from stanchion.llm.license_scan import license_scan

    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("file "), F.col("id").cast("string"), F.lit(" Licensed under the MIT License. end")).alias("text"))
    assert {(r.labels, r.score) for r in license_scan(df).collect()} == {("mit", 1.0)}


def test_license_titles_and_tags(spark):
    from stanchion.llm.license_scan import NOTICES, license_scan

    cases = {
        "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "# SPDX-License-Identifier: BSD-3-Clause\nimport os": "bsd-3-clause",
        "BSD 2-Clause License\n\nCopyright (c) 2020": "bsd-2-clause",
        "Artistic License 2.0": "artistic-2.0",
        "CC BY-SA 3.0": "cc-by,cc-by-sa-3.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "gpl,gpl-2.0",
        "the identifier of a license in SPDX is not here, nor is Apache 2.0": "",
        "a clause of the license says 2 things": "",
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: r.labels for r in license_scan(docs_of(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == list(cases.values())
    assert len(NOTICES) > 120 and all(text == text.lower() and keys for _, text, keys in NOTICES)


def test_license_notices_however_many(spark):
    """All notices in one document, notices in prose full of rare licence words, and damaged ones, against brute force."""
    from stanchion.llm import license_scan as L

    rng = random.Random(9)
    licence = sorted({x for _, t, _ in L.NOTICES for x in t.split()})
    whole = [t for _, t, _ in L.NOTICES]
    rows = [(0, " ".join(whole)), (1, " / ".join(whole[::-1])), (2, " ".join(rng.choice(licence + ["prose"]) for _ in range(3000)) + " " + whole[0])]
    for i in range(3, 60):
        words = [rng.choice(VOCAB) for _ in range(10)]
        for t in rng.sample(whole, rng.randint(0, 3)):
            words += [rng.choice(VOCAB) if rng.random() < 0.12 else x for x in t.split()][rng.choice([0, 0, 1]) :] + rng.sample(licence, rng.randint(0, 9))
        rows.append((i, " ".join(words)))
    rows += [(i, "the of a is under this") for i in range(60, 100)] + [(100, " ".join(whole[0].split()[2:])), (101, "licensed under the")]
    got = {r.doc_id: r for r in L.license_scan(docs_of(spark, rows).repartition(2)).collect()}
    texts = {i: t.translate(LOWER).replace("/", " ").split() for i, t in rows}
    idf = {x: np.log(1 + (len(rows) + 1) / (sum(x in t for t in map(set, texts.values())) + 1)) for x in licence}
    for i, w in texts.items():
        best = {}
        for label, text, keys in L.NOTICES:
            t = text.split()
            total = sum(idf[x] for x in t)
            for d in range(1 - len(t), len(w)):
                score = sum(idf[x] for q, x in enumerate(t) if 0 <= d + q < len(w) and w[d + q] == x) / total
                reach = f" {' '.join(w[max(0, d - L.SLACK) : d + len(t) + L.SLACK])} "
                if score >= L.ENOUGH and all(f" {k} " in reach for k in keys):
                    one = (round(-score, 6), max(0, d), min(len(w), d + len(t)))
                    if label not in best or one[:2] < best[label][:2]:
                        best[label] = one
        assert [(x.label, round(-x.score, 6), x.start, x.end) for x in got[i].spans] == [(k, *best[k]) for k in sorted(best)], i
    assert {x.label for x in got[0].spans} == {x for x, _, _ in L.NOTICES} and "apache-2.0" in got[2].labels


def test_toxicity(spark, empty):
    from stanchion.llm.toxicity import held_out, score, train

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(1, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randint(0, len(words) - 1)] = rng.choice(["bozo", "dimwit", "Nincompoop"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(5, 1), (6, None), (10_000, 1), (None, 1)]
    rows += [(700, None), (701, ""), (702, "quiet " * 20_000)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = docs_of(spark, rows)
    model = train(df, lab)
    out = {r.doc_id: r for r in score(df, model).withColumn("held", held_out()).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held} == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((out[i].toxicity_score >= 0.5) == (i % 5 == 0) for i in held) / len(held)
    assert right > 0.97 and out[700].toxicity_score == out[701].toxicity_score < 0.5 and out[702].toxicity_score < 0.5
    assert out[3].grp == 1 and len(out) == len(rows)
    assert train(df, lab.filter("toxic = 0")) is None and score(df, None).filter("toxicity_score > 0").count() == 0
    assert score(empty, model).count() == 0 and train(empty, lab) is None


def test_toxicity_by_definition(spark, monkeypatch):
    """Counts, ratios, chi-square, selection and scores by dictionaries of character n-grams, and the weights by what makes them
    best: the penalised likelihood is flat there."""
    from stanchion.llm import toxicity as T

    monkeypatch.setattr(T, "FEATURES", 40)
    monkeypatch.setattr(T, "STEPS", 30_000)
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, 9))) + (" dümwit" if i % 4 == 0 and rng.random() < 0.8 else "") for i in range(160)}
    labels = {i: int(i % 4 == 0) for i in texts}
    model = T.train(docs_of(spark, list(texts.items())), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity_score for r in T.score(docs_of(spark, list(texts.items())), model).collect()}

    def grams(text):
        return {t[i : i + k] for t in [text.translate(LOWER)] for k in T.GRAMS for i in range(len(t) - k + 1)}

    def place(gram):
        body = gram.encode()
        found = [p[w] for p, w in T._places(*T._characters(np.frombuffer(body, np.uint8), np.array([0, len(body)])))]
        return int(found[-1][0])

    known = {g: place(g) for t in texts.values() for g in grams(t)}
    assert len(set(known.values())) == len(known)  # no two share a place here
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    y = np.array([labels[i] for i in learned])
    seen = {g: [sum(g in grams(texts[i]) and labels[i] == k for i in learned) for k in (0, 1)] for g in known}
    total = [sum(c[k] for c in seen.values()) + (1 << T.BITS) for k in (0, 1)]
    size = [int((y == k).sum()) for k in (0, 1)]
    ratio, apart = {}, {}
    for g, (q, p) in seen.items():
        if q + p >= 3:
            share = (p + q) / len(y)
            ratio[g] = np.log((p + 1) / total[1]) - np.log((q + 1) / total[0])
            apart[g] = (p / size[1] - q / size[0]) ** 2 / max(share * (1 - share), 1e-12)
    best = sorted((g for g in apart if apart[g] > 0), key=lambda g: (-round(apart[g], 12), known[g]))[:40]
    edge = round(apart[best[-1]], 12)
    chosen = {g for g in known if model.table[known[g]] >= 0}
    assert {g for g in best if round(apart[g], 12) > edge} <= chosen and all(round(apart[g], 12) >= edge for g in chosen) and len(chosen) == 40
    weight = {g: model.weights[model.table[known[g]]] for g in chosen}
    for i, t in texts.items():
        z = model.bias + sum(weight[g] for g in grams(t) & chosen)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    x = np.array([[ratio[g] if g in grams(texts[i]) else 0.0 for g in sorted(chosen)] for i in learned])
    w = np.array([weight[g] / ratio[g] for g in sorted(chosen)])
    off = 1 / (1 + np.exp(-(x @ w + model.bias))) - y
    assert abs(off.sum()) < 1e-3 and np.abs(x.T @ off + T.L2 * w).max() < 1e-3


def test_token_output(spark, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from stanchion.llm import token_store as T

    path = P.path("byte_bpe_50k.json")
    rows = corpus() + [(300, "a \nb  c  d\x1c e <|endoftext|> it's\r\n\r\n x"), (301, "　 \n日本 語"), (None, "nul"), (302, "tail  \n "), (-(2**63), "first"), (2**63 - 1, "last")]
    out = str(tmp_path / "store")
    T.SHARD_BYTES, kept = 2000, T.SHARD_BYTES
    try:
        T.write_tokens(docs_of(spark, rows).repartition(3), out, path)
    finally:
        T.SHARD_BYTES = kept
    got = T.read_tokens(spark, out).collect()
    tok, start = Tokenizer.from_file(path), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    by_id = {r.doc_id: r for r in got}
    for i, text in order:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        r = by_id[i]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert T.read_document(spark, out, -(2**63)) == by_id[-(2**63)].ids
    assert T.read_document(spark, out, 300) == by_id[300].ids and T.read_document(spark, out, 999) is None
    T.write_tokens(empty, str(tmp_path / "none"), path)
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_units_are_bounded():
    P = pytest.importorskip("public_tokenizers")
    from stanchion.llm import token_store as T

    path = P.path("byte_bpe_50k.json")
    T._UNITS.clear()
    T.MOST_UNITS, kept = 50, T.MOST_UNITS
    try:
        for k in range(20):
            raw = " ".join(f"w{i * k % 97}" for i in range(60)).encode()
            data = np.frombuffer(raw, np.uint8)
            ids, _ = T.encode_chunk(path, data, np.array([0, len(raw)]))
            assert ids.tolist() == T.tokenizer(path)[0].encode(raw.decode(), add_special_tokens=False).ids
            assert len(T._UNITS[path].keys) <= 50
    finally:
        T.MOST_UNITS = kept


def test_pieces(spark, empty):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from stanchion.llm import pieces as X

    path = P.path("piece_bpe_32k.model")
    rows = corpus() + [(400, "a▁b  c "), (401, "   "), (402, "\U0001f600é́ \x00z"), (403, "y" * 5000)]
    df = docs_of(spark, rows)
    enc = X.encode(df, path)
    got = {r.doc_id: r for r in enc.collect()}
    back = {r.doc_id: r.text for r in X.decode(enc, path).collect()}
    assert all(back[i] == (t or "") and got[i].exact for i, t in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i).encode(): (sp.get_score(i), i) for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)}
    auto = X.automaton(path)
    for i, text in rows[:25] + rows[-1:]:
        raw = (" " + text if text else "").replace(" ", "▁").encode()
        if len(raw) > 6000 or "▁" in (text or ""):
            continue
        best, back_ = [0.0] + [None] * len(raw), [None] * (len(raw) + 1)
        for p in range(1, len(raw) + 1):
            best[p], back_[p] = best[p - 1] + auto.fallback, (p - 1, int(auto.byte_ids[raw[p - 1]]))
            for k in range(min(48, p), 0, -1):
                v = known.get(raw[p - k : p])
                if v and best[p - k] + v[0] > best[p]:
                    best[p], back_[p] = best[p - k] + v[0], (p - k, v[1])
        ids, p = [], len(raw)
        while p:
            p, x = back_[p]
            ids.append(x)
        assert got[i].ids == ids[::-1] and abs(got[i].score - best[-1]) < 1e-6
    assert X.encode(empty, path).count() == 0 and X.round_trip(df, path).filter("not exact").count() == 0


def test_long_segments(spark):
    """A text without spaces: one segment of any length, by the plain loop, as the array steps give it."""
    import time

    P = pytest.importorskip("public_tokenizers")
    from stanchion.llm import pieces as X

    path = P.path("piece_bpe_32k.model")
    auto, rng = X.automaton(path), random.Random(4)
    text = "".join(rng.choice(VOCAB + ["the", "ing", "▁", "🙂"]) for _ in range(3000)).encode()
    cells = np.frombuffer(text, np.uint8)[None, :]
    one, many = auto.segment_one(text), auto.segment(cells, np.array([len(text)]))
    assert all(np.array_equal(x, y) for x, y in zip(one, many))
    began = time.perf_counter()
    rows = [(1, "é" * 150_000), (2, "abc" * 150_000 + " tail"), (3, "abc" * 150_000 + " tail")]
    got = {r.doc_id: r for r in X.encode(docs_of(spark, rows), path).collect()}
    assert all(r.exact for r in got.values()) and got[2].ids == got[3].ids and time.perf_counter() - began < 60
    assert X.decode(X.encode(docs_of(spark, rows), path), path).filter("doc_id = 1").first().text == rows[0][1]


def test_queries_run(spark, data):
    """Every query gives rows with the columns of its contract."""
    pytest.importorskip("public_tokenizers")
    from stanchion.llm import queries as Q

    first = {"op1": "doc_id n_words n_base first_word last_word base_labels labels score", "op4": "doc_id held_out score predicted", "op5": "doc_id start n_tokens ids_crc32", "op8": "doc_id n_words n_removed kept_sha256", "op9": "query_id rank vec_id score", "op10": "doc_id n_shingles component_id", "op11": "first_id n_rows cents rows_crc ids_sha256 columns path rewritten", "op12": "doc_id n_features weight score rank", "op13": "vec_id n_links component_id kept"}
    for name, f in Q.queries().items():
        df = f(spark, data)
        assert df.count() > 0 and set(first.get(name.split("_")[0], "").split()) <= set(df.columns), name


def test_oracles(spark, data):
    """Every oracle of this subpackage against its query, over the whole smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from stanchion.llm import oracles, queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        got, want = queries.queries()[name](spark, data).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols, name
        plain = lambda x: "-" if pd.isna(x) else str(x) if isinstance(x, str) else repr(round(float(x), 6) + 0.0)
        rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))  # noqa: B023, E731
        assert rows(got) == rows(want), name
