"""Queries over tracked events, runs, fingerprints and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import polygon as P
from ..operators import audit, dwell, progress, similarity, splits, stats
from ..sources.tables import table
from . import carriers as C
from . import oracle as O
from .registry import query

HOUR = 3_600_000_000

_ISLANDS = f"""v AS (SELECT * FROM ({O.TRACKS}) WHERE violating),
m AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w > {36 * HOUR} THEN 1 ELSE 0 END AS opens FROM v WINDOW w AS (PARTITION BY track_id ORDER BY ts_us)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY ts_us)::BIGINT AS incident FROM m)"""


def _violating(spark, d):
    return C.tracks(spark, d).filter("violating").withColumn("missing", F.array(F.lit(1), F.lit(2)))


@query(f"WITH {_ISLANDS} SELECT track_id, incident, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) AS n FROM i GROUP BY 1, 2")
def incident_islands(spark, d):
    return dwell.islands(_violating(spark, d), 36 * HOUR)


@query(f"""WITH v AS (SELECT *, event_type = 'purchase' AS closes FROM ({O.TRACKS}) WHERE violating OR event_type = 'purchase'),
m AS (SELECT *, CASE WHEN NOT closes AND (lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w > {36 * HOUR} OR lag(closes) OVER w) THEN 1 ELSE 0 END AS opens FROM v WINDOW w AS (PARTITION BY track_id ORDER BY ts_us)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY ts_us)::BIGINT AS incident FROM m)
SELECT track_id, incident, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) AS n FROM i WHERE NOT closes GROUP BY 1, 2""")
def resolved_incidents(spark, d):
    """A purchase ends the track's incident at once."""
    t = C.tracks(spark, d).withColumn("closes", F.col("event_type") == "purchase").filter("violating or closes")
    return dwell.islands(t, 36 * HOUR, closes="closes")


@query(f"""WITH {_ISLANDS}, s AS (SELECT *, min(ts_us) OVER (PARTITION BY track_id, incident) AS started_us FROM i),
f AS (SELECT *, row_number() OVER (PARTITION BY track_id, incident ORDER BY ts_us) AS nth FROM s WHERE ts_us - started_us >= {24 * HOUR})
SELECT track_id, incident, started_us, ts_us AS fired_us, 'helmet+vest' AS missing FROM f WHERE nth = 1""")
def dwell_alerts(spark, d):
    out = dwell.alerts(_violating(spark, d), 24 * HOUR, 36 * HOUR)
    return out.withColumn("missing", N.join_classes(F.col("missing")))


@query(f"""SELECT track_id, event_id, ts_us, CASE WHEN seen IS NULL OR ts_us - seen > {12 * HOUR} THEN 1 ELSE 0 END AS n_missing
FROM (SELECT *, last_value(CASE WHEN worn THEN ts_us END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM ({O.TRACKS}))""")
def ppe_memory_missing(spark, d):
    seen = C.tracks(spark, d).withColumn("worn", F.when(F.col("worn"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return dwell.remembered(seen, [1], 12 * HOUR).select("track_id", "event_id", "ts_us", F.size("missing").alias("n_missing"))


@query("SELECT event_type, count(*) AS frames, count(*) FILTER (WHERE value > 50) AS alerts, count(DISTINCT user_id) AS people FROM events GROUP BY event_type")
def running_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("frames"), F.count_if(F.col("value") > 50).alias("alerts"), F.count_distinct("user_id").alias("people"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def newest_per_track(spark, d):
    return progress.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH l AS (SELECT user_id, ts, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before, event_id FROM events)
SELECT event_id, CASE WHEN value >= before THEN value - before ELSE value END AS delta FROM l""")
def counter_deltas(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return progress.deltas(e, ["user_id"], "at", "value").select("event_id", "delta")


@query("""WITH e AS (SELECT user_id, value, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS epoch FROM events),
l AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY epoch), 0) AS before, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) AS back FROM e),
dd AS (SELECT *, CASE WHEN value >= before THEN value - before ELSE value END AS delta FROM l),
g AS (SELECT user_id, max(epoch) AS epoch, max(value) AS best, list(delta ORDER BY delta) FILTER (WHERE back <= 10 AND delta > 0) AS r FROM dd GROUP BY user_id),
b AS (SELECT g.*, (SELECT min(epoch) FROM dd WHERE dd.user_id = g.user_id AND dd.value = g.best) AS best_epoch, r[len(r) // 2 + 1] AS seconds_per_epoch FROM g)
SELECT user_id, epoch, best, best_epoch, epoch - best_epoch AS since_best, seconds_per_epoch,
       CASE WHEN least(200 - epoch, 50 - (epoch - best_epoch)) > 0 THEN least(200 - epoch, 50 - (epoch - best_epoch)) * seconds_per_epoch / 60 ELSE 0 END AS eta_min FROM b""")
def progress_pace(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("epoch", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return progress.pace(e, ["user_id"], "epoch", "value", "value")


@query("""WITH m AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT event_type, value, n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM m WHERE i > 15 OR n <= 15),
a AS (SELECT event_type, max(n) AS frames, count(*) AS measured, avg(value) AS mean_ms, max(value) FILTER (WHERE k = c // 2) AS median_ms, max(value) FILTER (WHERE k = least(c - 1, floor(c * 0.95))) AS p95_ms FROM k GROUP BY event_type)
SELECT event_type, frames, measured, round(mean_ms, 6) AS mean_ms, median_ms, p95_ms, round(1000.0 / nullif(mean_ms, 0), 6) AS mean_fps, round(1000.0 / nullif(median_ms, 0), 6) AS median_fps FROM a""")
def latency_summary(spark, d):
    out = audit.latency(table(spark, d, "events"), ["event_type"], "event_id", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "mean_fps", "median_fps")})


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY event_type")
def timing_stats(spark, d):
    return audit.timing(table(spark, d, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


_BITS = lambda lo: " + ".join(f"(CASE WHEN embedding[{lo + i + 1}] > 0 THEN {1 << i}::BIGINT ELSE 0 END)" for i in range(32))
_PRINTS = f"prints AS (SELECT vec_id, {_BITS(0)} AS lo, {_BITS(32)} AS hi FROM embeddings)"
_FAR = "(bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)))"


def _prints(spark, d):
    from ..functions.bits import sign_bits

    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("stem"), sign_bits(F.col("embedding"), 1, 32).alias("lo"), sign_bits(F.col("embedding"), 33, 32).alias("hi"))
    return p.filter("stem % 2 = 0"), p.filter("stem % 2 = 1")


@query(f"WITH {_PRINTS} SELECT q.vec_id AS query, r.vec_id AS reference, {_FAR}::INT AS distance FROM prints q JOIN prints r ON q.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND {_FAR} <= 18")
def hamming_pairs(spark, d):
    """Even against odd vectors: the two datasets of the operator."""
    return similarity.within_words(*_prints(spark, d), 18, ["lo", "hi"], bits=32)


@query(f"WITH {_PRINTS} SELECT q.vec_id AS query, min({_FAR})::INT AS distance FROM prints q JOIN prints r ON q.vec_id % 2 = 0 AND r.vec_id % 2 = 1 GROUP BY 1")
def nearest_hamming(spark, d):
    return similarity.nearest(*_prints(spark, d), ["lo", "hi"], bits=32)


_PAIRS = "pairs AS (SELECT p_partkey AS a, s_suppkey AS b, bit_count(xor(p_partkey * 2654435761, s_suppkey * 2654435761))::INT AS distance FROM part, supplier WHERE bit_count(xor(p_partkey * 2654435761, s_suppkey * 2654435761)) <= 4)"
_SPLITS = """splits AS (SELECT 'part' AS dataset, CASE p_partkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, p_partkey AS stem FROM part
  UNION ALL SELECT 'supplier', CASE (s_suppkey + 1) % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END, s_suppkey FROM supplier)"""


def _pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("stem"), (F.col("p_partkey") * 2654435761).alias("hash"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stem"), (F.col("s_suppkey") * 2654435761).alias("hash"))
    return similarity.within(p, s, 4)


def _both(spark, d):
    return _pairs(spark, d).select(F.lit("part").alias("dataset_a"), F.col("query").alias("a"), F.lit("supplier").alias("dataset_b"), F.col("reference").alias("b"), "distance")


def _splits(spark, d):
    role = lambda c, by=0: F.when((F.col(c) + by) % 5 == 0, "val").when((F.col(c) + by) % 5 == 1, "test").otherwise("train")
    p = table(spark, d, "part").select(F.lit("part").alias("dataset"), role("p_partkey").alias("split"), F.col("p_partkey").alias("stem"))
    return p.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("dataset"), role("s_suppkey", 1).alias("split"), F.col("s_suppkey").alias("stem")))


@query(f"WITH {_PAIRS} SELECT a AS query, b AS reference, distance FROM pairs")
def hamming_bands(spark, d):
    return _pairs(spark, d)


@query(f"""WITH {_PAIRS}, {_SPLITS} SELECT DISTINCT b AS evaluated, a AS trained, distance FROM pairs
WHERE b IN (SELECT stem FROM splits WHERE dataset = 'supplier' AND split IN ('val', 'test')) AND a IN (SELECT stem FROM splits WHERE dataset = 'part' AND split = 'train')""")
def leaking_semi(spark, d):
    return similarity.leaking(_both(spark, d), _splits(spark, d), "part", "supplier")


@query(f"""WITH {_PAIRS}, {_SPLITS}, x AS (SELECT 'part' AS dataset, a AS stem FROM pairs UNION SELECT 'supplier', b FROM pairs)
SELECT s.dataset, s.split, count(*) AS n FROM splits s LEFT JOIN x ON s.dataset = x.dataset AND s.stem = x.stem WHERE x.stem IS NULL OR s.split = 'train' GROUP BY 1, 2""")
def exclusion_anti(spark, d):
    kept = similarity.without(_splits(spark, d), similarity.exclusions(_both(spark, d)))
    return kept.groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLITS} SELECT p_partkey AS stem, coalesce((SELECT split FROM splits WHERE dataset = 'part' AND stem = p_partkey + 3 AND split IN ('val', 'test')), 'none') AS split FROM part")
def split_lookup(spark, d):
    stems = table(spark, d, "part").select(F.lit("part").alias("dataset"), (F.col("p_partkey") + 3).alias("stem"))
    return similarity.split_of(stems, _splits(spark, d), ["val", "test"]).select((F.col("stem") - 3).alias("stem"), "split")


@query(f"WITH {_SPLITS} SELECT dataset, split, count(*) AS n, substr(sha1(string_agg(stem::VARCHAR, chr(10) ORDER BY stem::VARCHAR)), 1, 12) AS id FROM splits GROUP BY 1, 2")
def split_ids(spark, d):
    return splits.split_ids(_splits(spark, d), ["dataset", "split"], "stem")


@query(f"WITH {_SPLITS}, s AS (SELECT DISTINCT split, stem % 7 AS k FROM splits) SELECT a.split AS a, b.split AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.split < b.split GROUP BY 1, 2")
def set_overlap(spark, d):
    return splits.overlaps(_splits(spark, d).withColumn("k", F.col("stem") % 7), "split", "k")


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id::VARCHAR), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN i <= round_even(n * 0.1::DOUBLE, 0) THEN 'minority' ELSE 'majority' END AS side FROM o""")
def stratified_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return splits.stratified(docs, 0.1, "doc_id", "lang")


@query(f"WITH c AS (SELECT image_id, string_agg(DISTINCT cls::VARCHAR, '-' ORDER BY cls::VARCHAR) AS s FROM ({O.BOXES}) WHERE cls > 0 GROUP BY 1) SELECT coalesce(c.s, 'background') AS stratum, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS image_id FROM lineitem) i LEFT JOIN c USING (image_id) GROUP BY 1")
def strata_counts(spark, d):
    boxes = C.boxes(spark, d)
    return splits.strata(boxes.select("image_id").distinct(), boxes.filter("cls > 0")).groupBy("stratum").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('0|' || doc_id::VARCHAR), doc_id LIMIT 25")
def deterministic_sample(spark, d):
    """A sampling operator: the limit is the feature."""
    return splits.sample(table(spark, d, "documents").select("doc_id"), 25, "doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'labels' WHEN l.doc_id IS NULL THEN 'images' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def presence_check(spark, d):
    return splits.presence(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups_md5(spark, d):
    return audit.duplicate_groups(table(spark, d, "documents"), F.col("text").cast("binary"), "doc_id")


@query("""WITH t AS (SELECT unnest([200, 500, 1000, 2000, 5000])::BIGINT AS threshold)
SELECT threshold, count(*) FILTER (WHERE toxic = 1 AND n_chars >= threshold) AS tp, count(*) FILTER (WHERE toxic = 0 AND n_chars >= threshold) AS fp,
       count(*) FILTER (WHERE toxic = 1 AND n_chars < threshold) AS fn, count(*) FILTER (WHERE toxic = 0 AND n_chars < threshold) AS tn FROM labels JOIN documents USING (doc_id), t GROUP BY threshold""")
def score_threshold_roc(spark, d):
    met = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    met = met.withColumn("threshold", F.explode(F.array(*(F.lit(t).cast("long") for t in (200, 500, 1000, 2000, 5000)))))
    truth, flagged = F.col("toxic") == 1, F.col("n_chars") >= F.col("threshold")
    return met.groupBy("threshold").agg(F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"), F.count_if(truth & ~flagged).alias("fn"), F.count_if(~truth & ~flagged).alias("tn"))


# ---------------------------------------------------------------------------------------- run scores

_S = f"s AS (SELECT * FROM ({O.SCORES}))"


@query("""SELECT (row_number() OVER (ORDER BY seed, model, direction) - 1)::INT AS ordinal, seed, model, direction
FROM (SELECT DISTINCT (l_linenumber % 3)::INT AS seed FROM lineitem), (SELECT DISTINCT l_returnflag AS model FROM lineitem), (SELECT DISTINCT l_linestatus AS direction FROM lineitem)""")
def grid_cells(spark, d):
    """Runs of all seeds, models and directions that the tables have; these are a few values each."""
    t = table(spark, d, "lineitem")
    few = lambda c: sorted(r[0] for r in t.select(c).distinct().collect())
    return progress.run_grid(spark, few("l_returnflag"), few("l_linestatus"), few((F.col("l_linenumber") % 3).cast("int")))


@query(f"WITH {_S} SELECT model, trained_on, round(avg(CASE WHEN tested = 0 THEN value END), 9) AS in_domain, round(avg(CASE WHEN tested = 1 THEN value END), 9) AS cross_domain, round(avg(CASE WHEN tested = 1 THEN value END) - avg(CASE WHEN tested = 0 THEN value END), 9) AS delta FROM s GROUP BY 1, 2")
def transfer_grid(spark, d):
    s = C.scores(spark, d).withColumn("home", F.lit(0))
    out = stats.transfer(s, ["model", "trained_on"], "home", "tested")
    return out.withColumns({c: F.round(c, 9) for c in ("in_domain", "cross_domain", "delta")})


@query(f"WITH {_S} SELECT model, trained_on, round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high, count(*) AS n, grouping(trained_on) = 1 AS pooled FROM s GROUP BY GROUPING SETS ((model, trained_on), (model))")
def pooled_grouping_sets(spark, d):
    return stats.cells(C.scores(spark, d), "model", "trained_on").withColumn("mean", F.round("mean", 9))


_RANKED = f"""{_S}, rk AS (SELECT tested, model, trained_on, seed, value, rank() OVER (PARTITION BY tested, trained_on, seed ORDER BY value DESC) + (count(*) OVER (PARTITION BY tested, trained_on, seed, value) - 1) / 2.0::DOUBLE AS rank FROM s)"""


@query(f"WITH {_RANKED} SELECT tested, model, round(avg(rank), 9) AS mean_rank, count(*) AS blocks FROM rk GROUP BY 1, 2")
def mean_ranks(spark, d):
    return stats.mean_ranks(C.scores(spark, d), "model", ["trained_on", "seed"], ["tested"]).withColumn("mean_rank", F.round("mean_rank", 9))


_FRIEDMAN = f"""{_RANKED},
sz AS (SELECT tested, count(*) AS k, max(n) AS n, min(n) AS lo FROM (SELECT tested, model, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
ti AS (SELECT tested, sum(t * t * t - t) AS ties FROM (SELECT tested, trained_on, seed, value, count(*) AS t FROM s GROUP BY 1, 2, 3, 4) GROUP BY 1),
su AS (SELECT tested, sum(r * r) AS ss FROM (SELECT tested, model, sum(rank) AS r FROM rk GROUP BY 1, 2) GROUP BY 1),
fr AS (SELECT tested, k, n, lo, CASE WHEN k >= 3 AND lo = n AND n >= 2 THEN (12.0::DOUBLE / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties::DOUBLE / (n * k * (k * k - 1))) END AS statistic,
         CASE WHEN k < 3 THEN 'needs three models or more' WHEN lo <> n THEN 'unequal blocks' WHEN n < 2 THEN 'needs two blocks or more' END AS error FROM sz JOIN ti USING (tested) JOIN su USING (tested))"""


@query(f"WITH {_FRIEDMAN} SELECT tested, k::INT AS k, n AS blocks, round(statistic, 6) AS statistic, round(exp(-statistic / 2), 6) AS p, CASE WHEN error IS NULL THEN round(2.343 * sqrt(k * (k + 1) / (6.0::DOUBLE * n)), 6) END AS critical_difference, error FROM fr")
def friedman(spark, d):
    out = stats.friedman(C.scores(spark, d), "model", ["trained_on", "seed"], ["tested"])
    return out.withColumns({c: F.round(c, 6) for c in ("statistic", "p", "critical_difference")})


_DIFFS = f"{_S}, df AS (SELECT x.tested, x.model AS a, y.model AS b, x.trained_on || x.seed AS block, x.value - y.value AS d FROM s x JOIN s y ON x.tested = y.tested AND x.trained_on = y.trained_on AND x.seed = y.seed AND x.model < y.model)"
_FLIP = f"""{_DIFFS},
g AS (SELECT tested, a, b, list(d ORDER BY block) AS d, count(*) AS n FROM df GROUP BY 1, 2, 3),
fl AS (SELECT g.*, list_transform(range(0, (1 << n)::BIGINT), lambda v: abs(list_sum(list_transform(range(0, n), lambda i: CASE WHEN (v >> i) & 1 = 1 THEN -d[i + 1] ELSE d[i + 1] END)) / n)) AS sums FROM g),
pv AS (SELECT tested, a, b, n::INT AS n, round(list_sum(d) / n, 9) AS mean_diff, len(list_filter(sums, lambda x: x >= abs(list_sum(d) / n) - 1e-12))::DOUBLE / (1 << n)::DOUBLE AS p, least(1.0::DOUBLE, 2.0::DOUBLE / pow(2.0::DOUBLE, n)) AS min_p FROM fl)"""


def _flips(spark, d):
    s = C.scores(spark, d)
    diffs = stats.aligned(s, "model", ["tested", "trained_on", "seed"]).withColumn("block", F.concat("trained_on", F.col("seed").cast("string")))
    return stats.sign_flip(diffs, ["tested", "a", "b"], order="block", most=stats.WHOLE)  # six blocks


@query(f"WITH {_FLIP} SELECT * FROM pv")
def sign_flip(spark, d):
    return _flips(spark, d).withColumn("mean_diff", F.round("mean_diff", 9))


@query(f"""WITH {_FLIP}, h AS (SELECT tested, a || '-' || b AS metric, p, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY tested) - row_number() OVER w + 1) * p) AS step FROM pv WINDOW w AS (PARTITION BY tested ORDER BY p, a || '-' || b))
SELECT tested, metric, p, max(step) OVER (PARTITION BY tested ORDER BY p, metric ROWS UNBOUNDED PRECEDING) AS adjusted FROM h""")
def holm(spark, d):
    tests = _flips(spark, d).select("tested", F.concat_ws("-", "a", "b").alias("metric"), "p")
    return stats.holm(tests, ["tested"])


@query(f"""WITH {_RANKED}, m AS (SELECT model, round(avg(rank), 9) AS r FROM rk GROUP BY 1),
runs AS (SELECT low, max(x) AS high, max(c) AS models FROM (SELECT a.r AS low, b.r AS x, count(*) OVER (PARTITION BY a.model) AS c FROM m a JOIN m b ON b.r >= a.r AND b.r - a.r <= 0.6) GROUP BY low HAVING max(c) > 1)
SELECT low, high, models FROM runs q WHERE NOT EXISTS (SELECT 1 FROM runs w WHERE w.low <= q.low AND w.high >= q.high AND (w.low < q.low OR w.high > q.high))""")
def cd_cliques(spark, d):
    m = stats.mean_ranks(C.scores(spark, d), "model", ["tested", "trained_on", "seed"]).withColumn("mean_rank", F.round("mean_rank", 9))
    return stats.cliques(m, 0.6)


@query()
def nemenyi(spark, d):
    """No oracle: the studentised range is integrated numerically."""
    return stats.nemenyi(stats.mean_ranks(C.scores(spark, d), "model", ["trained_on", "seed"], ["tested"]), ["tested"])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'resumable' ELSE 'pending' END AS state FROM orders WHERE o_orderstatus <> 'F'")
def due_runs(spark, d):
    o = table(spark, d, "orders")
    return progress.due(o.select("o_orderkey"), o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority like '1%'"), "o_orderkey")


@query()
def bootstrap_intervals(spark, d):
    """No oracle: the replicates come from a seeded generator."""
    s = C.scores(spark, d).withColumn("seed", F.concat("trained_on", F.col("seed").cast("string"), F.col("tested").cast("string")))
    return stats.intervals(s, ["model"])


# ---------------------------------------------------------------------------------------- scalars and checks


@query("SELECT c_custkey, 'X04-' || lower(c_mktsegment) || '-s' || (c_custkey % 3)::VARCHAR || '-chv' AS run_id, lower(c_mktsegment) AS model, (c_custkey % 3)::INT AS seed, 'chv' AS dataset FROM customer")
def run_id_parse(spark, d):
    c = table(spark, d, "customer").withColumn("run_id", N.build_run(F.lit("X04"), F.lower("c_mktsegment"), F.col("c_custkey") % 3, F.lit("chv")))
    return c.withColumn("p", N.parse_run(F.col("run_id"))).select("c_custkey", "run_id", "p.model", "p.seed", "p.dataset")


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN lower(url) SIMILAR TO '(rtsp|rtmp|http|https)://.*' THEN 'stream' ELSE 'file' END AS kind FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", N.basename(F.col("url")).alias("base"), N.stem(F.col("url")).alias("stem"), N.source_kind(F.col("url")).alias("kind"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(N.escape_html(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", N.iso_seconds(F.col("ts")).alias("at"))


@query("""WITH v AS (SELECT p_partkey, [0.0, 0.5 + p_size / 200.0, 0.75, p_partkey % 89 / 200.0]::DOUBLE[] AS x, [0.0, p_partkey % 83 / 200.0, 0.75, 0.5 + p_size / 250.0]::DOUBLE[] AS y FROM part)
SELECT p_partkey, round(abs(list_sum(list_transform(range(1, 5), lambda i: x[i] * y[i % 4 + 1] - x[i % 4 + 1] * y[i]))) / 2, 9) AS area FROM v""")
def polygon_area(spark, d):
    """A quadrilateral of each row's own."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, size = F.col("p_partkey"), F.col("p_size")
    shape = F.array(corner(F.lit(0), F.lit(0)), corner(0.5 + size / 200, n % 83 / 200), corner(F.lit(0.75), F.lit(0.75)), corner(n % 89 / 200, 0.5 + size / 250))
    return table(spark, d, "part").select("p_partkey", F.round(P.shoelace(shape), 9).alias("area"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'resumable' ELSE 'pending' END AS state FROM orders")
def state_case(spark, d):
    state = progress.run_state(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"))
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"))


@query("SELECT s_nationkey, bool_and(s_acctbal > 0 OR s_suppkey % 2 = 0) AS passed, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_acctbal <= 0 AND s_suppkey % 2 = 1), []) AS failed, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_acctbal <= 0 AND s_suppkey % 2 = 0), []) AS warnings FROM supplier GROUP BY 1")
def preflight_gates(spark, d):
    checks = table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("passed"), (F.col("s_suppkey") % 2 == 1).alias("blocking"))
    return progress.gates(checks, ["s_nationkey"])


@query("SELECT p_brand, min(p_size) AS low, max(p_size) AS high, min(p_size) IS NOT DISTINCT FROM max(p_size) AS constant FROM part GROUP BY 1")
def constant_within(spark, d):
    return audit.constant_within(table(spark, d, "part"), ["p_brand"], "p_size")


@query("SELECT o_orderkey, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)")
def ragged_offsets(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders")
    counts = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return progress.offsets(counts, ["o_custkey"], "o_orderkey", "n").select("o_orderkey", "start")


@query("SELECT count(DISTINCT n_regionkey) <= 1 AS n_regionkey, count(DISTINCT 1) <= 1 AS one FROM nation")
def same_protocol(spark, d):
    return progress.same_protocol(table(spark, d, "nation").withColumn("one", F.lit(1)), ["n_regionkey", "one"])


@query("SELECT c_mktsegment, c_custkey, c_acctbal, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey))::INT AS rank FROM customer QUALIFY rank <= 3")
def topk_per_group(spark, d):
    return audit.top_k(table(spark, d, "customer"), 3, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_violations(spark, d):
    """The newest 200: a top-k report."""
    e = table(spark, d, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).orderBy("ts", "event_id").select("event_id", "value")


@query("SELECT page_id, contains(lower(url), 'example') OR contains(lower(html), 'lorem') AS hit FROM pages")
def forbidden_paths(spark, d):
    """Texts at several depths; the field `declared` is exempt."""
    p = table(spark, d, "pages").select("page_id", F.struct(F.array(F.struct("html")).alias("train"), F.create_map(F.lit("u"), F.col("url")).alias("more"), F.lit("Example").alias("declared")).alias("config"))
    found = progress.texts(F.col("config"), p.schema["config"].dataType, ("config.declared",), "config")
    return p.select("page_id", progress.forbidden(found, "Example", "LOREM").alias("hit"))


@query("SELECT md5(text) AS digest, doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def dup_members_md5(spark, d):
    return audit.duplicate_members(table(spark, d, "documents"), F.col("text").cast("binary"), "doc_id")


@query("SELECT lang, least(floor((log10(n_chars) - log10(10.0::DOUBLE)) / ((log10(100000.0::DOUBLE) - log10(10.0::DOUBLE)) / 16)), 15)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars >= 10 AND n_chars <= 100000 GROUP BY 1, 2")
def log_lengths(spark, d):
    return audit.log_histogram(table(spark, d, "documents"), F.col("n_chars"), 10.0, 100000.0, 16, ["lang"])


@query("SELECT p_partkey, greatest(round_even(p_size * 40 * least(1.0::DOUBLE, 640.0::DOUBLE / greatest(p_size * 40, 500)), 0), 1)::INT AS w, greatest(round_even(500 * least(1.0::DOUBLE, 640.0::DOUBLE / greatest(p_size * 40, 500)), 0), 1)::INT AS h FROM part")
def fitted_sizes(spark, d):
    from ..functions.geometry import fitted

    w, h = fitted(F.col("p_size") * 40, F.lit(500), 640)
    return table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))
