"""Keyed upsert: the files of the query against a brute-force run over lists, and its parts on odd rows."""

import hashlib
import math
import random
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from stanchion.llm import upsert as U
from stanchion.llm.queries import op11_keyed_upsert

CLIENTS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
SETS = ["source", "segment", "city", "balance"]
TYPES = pa.schema([("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()), ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int32()), ("segment", pa.string()), ("balance", pa.float64())])
CHANGES = pa.schema([("change_id", pa.int64()), ("client_id", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("valid_at", pa.timestamp("us")), ("source", pa.string()), ("segment", pa.string()), ("city", pa.string()), ("balance", pa.float64())])


def crc(x):
    return zlib.crc32(str(x).encode())


def tables(n=2150, changes=1500, seed=5, beyond=400):
    rng = random.Random(seed)
    day = datetime(2024, 1, 2)
    text = lambda: rng.choice([None, "", "web", "café", "x|y", "store"])
    money = lambda: rng.choice([None, 0.0, -0.0, 12.345, -7.005, float("nan"), round(rng.uniform(-999, 999), 2)])
    clients = [(i, rng.choice([None, i]), text(), day, f"n{i}", None, text(), rng.choice([None, 3]), text(), money()) for i in rng.sample(range(3 * n), n)]
    log = []
    for k in range(changes):
        i = rng.choice([7, rng.choice(clients)[0], rng.randrange(3 * n), 3 * n + rng.randrange(beyond), None])
        if k % 9 == 0:  # sets what is there already
            c = rng.choice(clients)
            log.append((k, c[0], 10**6, "U", day, c[2], c[8], c[6], c[9]))
        else:
            log.append((rng.choice([k, None]), i, rng.choice([None, rng.randrange(50)]), rng.choice(["U", "I", "D", None, "d"]), day, text(), text(), text(), money()))
    return clients, log + log[:40]


def brute(clients, log):
    """Files as lists of rows, in order: [(rows, rewritten)]."""
    m = 1 + len(clients) // 700
    rows = sorted((c for c in clients if c[0] is not None and crc(c[0]) % 7 > 3), key=lambda c: c[0])
    files = [rows[i : i + m] for i in range(0, len(rows), m)]
    if not files:
        return []
    firsts = [f[0][0] for f in files]
    last = {}
    least = lambda x: (x is not None, 0 if x is None else math.inf if x != x else x)
    order = lambda c: [least(c[k]) for k in (2, 0, 3, 4, 5, 6, 7, 8)]  # noqa: E731  exact ties go by the other columns
    for c in log:
        if c[1] is not None and (c[1] not in last or order(c) > order(last[c[1]])):
            last[c[1]] = c
    new = [list(f) for f in files]
    for i, c in last.items():
        home = max([k for k, f in enumerate(firsts) if f <= i], default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        at = [k for k, r in enumerate(new[home]) if r[0] == i]
        if c[3] == "D" or (c[0] is not None and crc(c[0]) % 8 < h):
            new[home] = [r for r in new[home] if r[0] != i]
        elif at:
            for k in at:
                r = list(new[home][k])
                r[2], r[8], r[6], r[9] = c[5:9]
                new[home][k] = tuple(r)
        else:
            new[home].append((i, None, c[5], None, None, None, c[7], None, c[6], c[8]))
    out = []
    same = lambda a, b: len(a) == len(b) and all(x == y or (x != x and y != y) for r, s in zip(a, b) for x, y in zip(r, s))
    for was, now in zip(files, new):
        now.sort(key=lambda r: r[0])
        if same(was, now):
            out.append((was, False))
            continue
        k, at = -(-len(now) // m), 0
        for j in range(k):
            size = len(now) // k + (j < len(now) % k)
            out.append((now[at : at + size], True))
            at += size
    joined = []
    for rows, fresh in out:
        if fresh and joined and joined[-1][1] and len(joined[-1][0]) + len(rows) <= m:
            joined[-1] = (joined[-1][0] + rows, True)
        else:
            joined.append((rows, fresh))
    return joined


def digest(rows):
    cents = lambda b: 0 if b is None or not math.isfinite(b) else math.floor(100 * b + 0.5)
    text = lambda r: "|".join(x or "" for x in (r[2], r[8], r[6]))
    return rows[0][0], len(rows), sum(cents(r[9]) for r in rows), sum(crc(text(r)) for r in rows), hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()


def write(top, clients, log):
    for name, rows, schema in (("clients", clients, TYPES), ("client_changes", log, CHANGES)):
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema), top / f"{name}.parquet")
    return str(top)


def local(path):
    return path.removeprefix("file:")


def test_files_are_those_of_a_brute_force_run(spark, tmp_path, seed=6):
    clients, log = tables(seed=seed)
    got = sorted(op11_keyed_upsert(spark, write(tmp_path, clients, log)).collect(), key=lambda r: r.first_id)
    want = brute(clients, log)
    assert [(r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got] == [(*digest(rows), fresh) for rows, fresh in want]
    assert sum(f for _, f in want) > 20 and sum(not f for _, f in want) > 20
    for r, (rows, _) in list(zip(got, want))[::7]:
        table = pq.ParquetFile(local(r.path)).read()
        assert r["columns"] == ",".join(CLIENTS) and table.column_names == CLIENTS
        assert repr([tuple(x.values()) for x in table.to_pylist()]) == repr([tuple(x) for x in rows])


def test_many_new_keys_in_one_home_and_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "PIECE", 64)
    clients, log = tables(n=900, changes=200)
    top = max(c[0] for c in clients)
    log += [(k, top + 1 + k, 0, "I", None, "web", "s", "c", 1.0) for k in range(600)]
    got = sorted(op11_keyed_upsert(spark, write(tmp_path, clients, log)).collect(), key=lambda r: r.first_id)
    assert [(r.first_id, r.n_rows, r.ids_sha256, r.rewritten) for r in got] == [(digest(x)[0], len(x), digest(x)[4], f) for x, f in brute(clients, log)]


def test_empty_tables(spark, tmp_path):
    assert op11_keyed_upsert(spark, write(tmp_path, [], [])).collect() == []
    clients, _ = tables(n=30)
    (tmp_path / "b").mkdir()
    got = op11_keyed_upsert(spark, write(tmp_path / "b", clients, [])).collect()
    assert len(got) == len(brute(clients, [])) and not any(r.rewritten for r in got)


def test_position_vectors():
    kind, key = np.array([0, 0, 0, 2, 0, 1, 1, 1]), np.array([1, 3, 3, 3, 5, 5, 6, 0])
    order = np.argsort(key, kind="stable")
    take, patch, gone = U.delta(kind[order], key[order])
    # 0 is new, 1 stays, both 3 go, 5 is patched, 6 is new
    assert key[order][take].tolist() == [0, 1, 5, 6] and key[order][gone].tolist() == [3, 3]
    assert (patch != take).tolist() == [False, False, True, False]


def test_clashing_columns_and_repeated_keys_over_two_files(spark):
    names = ["id", "key", "home", "at", "no", "_no", "row", "kind", "v"]
    rows = [(i, i, i, i, i, i, str(i), i, float(i)) for i in (1, 2, 2, 2, 3, 4)]
    df = spark.createDataFrame(rows, "id long, key int, home int, `at` int, no int, _no int, row string, kind int, v double")
    folder = U.new_table(spark)
    U.create(df, folder, "id", 2)
    changes = U.latest(spark.createDataFrame([(2, 9.5, 1), (9, 8.0, 1), (None, 1.0, 1)], "id long, v double, seq int"), "id", ["seq"])
    made = U.upsert(folder, changes, lambda first, change: U.F.lit("set"), df.schema, "id", ["v"], 2)
    got = sorted((r.id, r.v, r.key) for r in spark.read.parquet(folder).collect())
    assert got == [(1, 1.0, 1), (2, 9.5, 2), (2, 9.5, 2), (2, 9.5, 2), (3, 3.0, 3), (4, 4.0, 4), (9, 8.0, None)]
    assert spark.read.parquet(folder).columns == names and len(made) == 4
    again = U.upsert(folder, changes, lambda first, change: U.F.lit("set"), df.schema, "id", ["v"], 2)
    assert again == []
