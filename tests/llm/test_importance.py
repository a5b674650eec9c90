"""Importance resampling against a plain computation over dictionaries, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stanchion.llm.importance import crc32s, resample

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, grams):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute(docs, target, grams=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [(i, *features(t, grams)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in of for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, grams)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, words, fs in of:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return sorted((*((x is None, x or 0) for x in (*r[:4], rank.get(id(r)))),) for r in rows)


def made(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"Wort{j}" for j in range(60)] + ["ÀÉ", "naïve", "x-y", "a_b", "9", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 21, 200])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!? \t"), (n + 3, "lang" * 30_000), (n + 4, "viele Wörter " * 9_000), (5, docs[5][1]), (5, docs[5][1]), (None, "ein Text " * 30), (None, None), (2**63 - 1, "w " * 25), (-4, "w " * 25)]
    return docs, [" ".join(rng.choices(words[:20], k=60)) for _ in range(8)] + [None, ""]


@pytest.mark.parametrize("grams", [1, 2])
def test_as_by_definition(spark, grams):
    docs, target = made()
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in docs], "doc_id long, text string, words int, place string").repartition(5)
    got = resample(df, spark.createDataFrame([(x,) for x in target], "text string"), grams=grams).collect()
    assert sorted((*((x is None, x or 0) for x in r),) for r in got) == brute(docs, target, grams)
    assert sum(r.rank is not None for r in got) == 10 * sum(features(t, 1)[0] >= 20 for _, t in docs) // 100


def test_empty_tables(spark):
    docs, target = made(30)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((*((x is None, x or 0) for x in r),) for r in resample(df, none).collect()) == brute(docs, [])


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9_000, dtype=np.uint8)
    ends = np.cumsum(np.concatenate((rng.integers(0, 90, 150), [0, 1, 63, 64, 65, 1000])))
    starts = np.concatenate(([0], ends[:-1]))
    assert crc32s(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
