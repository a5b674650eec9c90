"""Queries over detections: association, matching, zones, confusion, calibration and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..functions import polygon as P
from ..operators import assign, audit, calibrate, frames, metrics, reports, zone
from ..sources.tables import kept, table
from . import carriers as C
from . import oracle as O
from .registry import query

_PEOPLE = "cls = 0 AND conf >= 25"
_STATES = f"""{O.BOUND},
states AS (
  SELECT p.image_id, p.box_idx AS person, p.xc, p.yc, p.w, p.h, p.conf, max(CASE WHEN b.cls = 1 THEN b.item END) AS helmet, max(CASE WHEN b.cls = 2 THEN b.item END) AS vest
  FROM boxes p LEFT JOIN bound b ON b.image_id = p.image_id AND b.person = p.box_idx WHERE p.cls = 0 GROUP BY ALL),
coded AS (SELECT *, 'W' || CASE WHEN helmet IS NOT NULL THEN 'H' ELSE '' END || CASE WHEN vest IS NOT NULL THEN 'V' ELSE '' END AS code FROM states)
"""


@query(f"WITH {_STATES} SELECT code, count(*) AS people FROM coded GROUP BY code")
def associate_codes(spark, d):
    boxes = C.boxes(spark, d)
    return assign.people_states(boxes, assign.bind(boxes)).groupBy("code").agg(F.count("*").alias("people"))


@query(f"WITH {O.BOUND} SELECT image_id, person, cls, item FROM bound")
def associate_bindings(spark, d):
    return assign.bind(C.boxes(spark, d))


@query(f"WITH {O.BOUND} SELECT b.image_id, b.box_idx AS item, b.cls FROM boxes b WHERE b.cls IN (1, 2) AND NOT EXISTS (SELECT 1 FROM bound x WHERE x.image_id = b.image_id AND x.item = b.box_idx)")
def associate_unbound(spark, d):
    boxes = C.boxes(spark, d)
    return assign.unbound(boxes, assign.bind(boxes)).select("image_id", "item", "cls")


@query(f"""WITH {O.CANDIDATES},
per AS (SELECT image_id, count(*) FILTER (WHERE cls = 0) AS p, count(*) FILTER (WHERE cls = 1) AS h, count(*) FILTER (WHERE cls IN (1, 2)) AS i FROM boxes GROUP BY image_id)
SELECT count(*) FILTER (WHERE p = 1 AND i > 0) AS single_person_images, count(*) FILTER (WHERE p > 1 AND i > 0) AS multi_person_images,
       count(*) FILTER (WHERE h > 0) AS helmet_images, count(*) FILTER (WHERE h > 0 AND h > p) AS excess_helmet_images,
       (SELECT count(*) FROM (SELECT image_id, item FROM cand GROUP BY 1, 2 HAVING count(*) > 1)) AS ambiguous_items FROM per""")
def association_ambiguity(spark, d):
    return calibrate.evidence(C.boxes(spark, d))


_DROPPED = f"""
boxes AS ({O.BOXES}),
pairs AS (
  SELECT a.image_id, a.box_idx AS small, b.box_idx AS large FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.cls = 0 AND b.cls = 0 AND a.box_idx <> b.box_idx
  WHERE b.w * b.h > a.w * a.h AND {O.contain("a.", "b.")} >= 0.8),
folded AS (
  SELECT image_id, list_reduce(list([{{'s': small::BIGINT, 'l': large::BIGINT}}] ORDER BY small, large),
    lambda acc, n: CASE WHEN len(list_filter(acc, lambda y: y.l = -1 AND (y.s = n[1].s OR y.s = n[1].l))) > 0 THEN acc ELSE list_concat(acc, [{{'s': n[1].s, 'l': -1::BIGINT}}]) END,
    [{{'s': -1::BIGINT, 'l': 0::BIGINT}}]) AS acc FROM pairs GROUP BY image_id),
dropped AS (SELECT image_id, t.s::INT AS box_idx FROM (SELECT image_id, unnest(acc) AS t FROM folded) WHERE t.l = -1)
"""


@query(f"WITH {_DROPPED} SELECT * FROM dropped")
def duplicate_people(spark, d):
    return assign.duplicate_people(C.boxes(spark, d))


@query(f"WITH {_DROPPED} SELECT b.cls, count(*) AS n FROM boxes b LEFT JOIN dropped d USING (image_id, box_idx) WHERE d.box_idx IS NULL GROUP BY b.cls")
def suppress_duplicates(spark, d):
    return assign.suppress_duplicates(C.boxes(spark, d)).groupBy("cls").agg(F.count("*").alias("n"))


def _predicted(spark, d):
    boxes = C.boxes(spark, d).filter("conf >= 25")
    people = boxes.filter(F.col("cls") == G.PERSON).withColumnRenamed("box_idx", "person")
    return boxes, people


@query(f"WITH {O.MATCHED} SELECT * FROM matched")
def match_workers(spark, d):
    return assign.match_people(_predicted(spark, d)[1], C.workers(spark, d))


# all items take part in the association; people only if confident
_CONFIDENT = O.BOUND.replace(f"boxes AS ({O.BOXES})", f"boxes AS (SELECT * FROM ({O.BOXES}) WHERE conf >= 25)")
_DECIDED = f"""{_CONFIDENT}, {O.MATCHED},
worn AS (SELECT image_id, person, bool_or(cls = 1) AS helmet, bool_or(cls = 2) AS vest FROM bound GROUP BY 1, 2),
decided AS (
  SELECT w.image_id, w.worker, w.helmet, w.vest, m.person IS NOT NULL AS detected,
         m.person IS NOT NULL AND NOT coalesce(x.helmet, false) AS flag_helmet, m.person IS NOT NULL AND NOT coalesce(x.vest, false) AS flag_vest
  FROM workers w LEFT JOIN matched m ON m.image_id = w.image_id AND m.worker = w.worker LEFT JOIN worn x ON x.image_id = m.image_id AND x.person = m.person),
axes AS (
  SELECT 'helmet' AS axis, NOT helmet AS truth, flag_helmet AS flagged, detected FROM decided
  UNION ALL SELECT 'vest', NOT vest, flag_vest, detected FROM decided)
"""
_CONFUSION = """count(*) FILTER (WHERE truth AND flagged) AS tp, count(*) FILTER (WHERE NOT truth AND flagged) AS fp, count(*) FILTER (WHERE truth AND NOT flagged) AS fn,
       count(*) FILTER (WHERE NOT truth AND NOT flagged) AS tn, count(*) FILTER (WHERE truth AND NOT flagged AND NOT detected) AS missed"""
_RATIOS = """SELECT *, tp + fn AS support, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision FROM c"""


def _rows(spark, d):
    """What is predicted, with what is labelled; and the crowded images."""
    return C.rows(spark, d, "conf >= 25"), assign.crowded([C.boxes(spark, d)], ["image_id"])


def _decided(spark, d):
    rows, crowd = _rows(spark, d)
    return metrics.decisions(rows, ["image_id"], ["helmet", "vest"], crowd, F.col("first"))


@query(f"""WITH {_DECIDED}, c AS (SELECT axis, {_CONFUSION} FROM axes GROUP BY axis), r AS ({_RATIOS})
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce((tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS base_rate,
       1.0::DOUBLE AS trivial_recall, coalesce((tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS trivial_precision FROM r""")
def violation_confusion(spark, d):
    long = metrics.by_class(_decided(spark, d))
    return metrics.with_ratios(metrics.confusion(long, ["axis"], F.col("truth"), F.col("flagged"), F.col("detected")))


@query(f"WITH {_DECIDED} SELECT count(*) AS workers, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE detected)::DOUBLE / count(*) AS detection_rate FROM decided")
def detection_rate(spark, d):
    return _decided(spark, d).agg(F.count("*").alias("workers"), F.count_if("detected").alias("detected")).withColumn("detection_rate", metrics.ratio(F.col("detected"), F.col("workers")))


#: The boundary of a standard zone is inside, with the edge tolerance; these are axis-parallel, so its oracle is a range test.
_ZONES = """zones AS (SELECT * FROM (VALUES ('central-half', 0.25, 0.0, 0.75, 1.0), ('lower-half', 0.0, 0.5, 1.0, 1.0), ('left-half', 0.0, 0.0, 0.5, 1.0), ('whole-frame', 0.0, 0.0, 1.0, 1.0)) z(zone, x1, y1, x2, y2))"""


def _inside(x: str, y: str) -> str:
    e = "1e-3::DOUBLE"
    return f"""(({x} > x1::DOUBLE AND {x} < x2::DOUBLE AND {y} > y1::DOUBLE AND {y} < y2::DOUBLE)
      OR (abs({x} - x1::DOUBLE) <= {e} OR abs({x} - x2::DOUBLE) <= {e}) AND ({y} - y1::DOUBLE) * (y2 - y1)::DOUBLE >= -{e} AND ({y} - y1::DOUBLE) * (y2 - y1)::DOUBLE <= (y2 - y1)::DOUBLE * (y2 - y1)::DOUBLE + {e}
      OR (abs({y} - y1::DOUBLE) <= {e} OR abs({y} - y2::DOUBLE) <= {e}) AND ({x} - x1::DOUBLE) * (x2 - x1)::DOUBLE >= -{e} AND ({x} - x1::DOUBLE) * (x2 - x1)::DOUBLE <= (x2 - x1)::DOUBLE * (x2 - x1)::DOUBLE + {e})"""


@query(f"""WITH {_ZONES}, p AS (SELECT *, xc AS fx, yc + h / 2 AS fy FROM ({O.BOXES}) WHERE cls = 0)
SELECT zone, count(*) AS people, count(*) FILTER (WHERE {_inside("fx", "fy")}) AS inside FROM p, zones GROUP BY zone""")
def zone_membership(spark, d):
    people = C.boxes(spark, d).filter(F.col("cls") == G.PERSON)
    return zone.with_fixed_zones(people).groupBy("zone").agg(F.count("*").alias("people"), F.count_if("in_zone").alias("inside"))


#: A hexagon with slanted sides and one vertex drawn inwards. The oracle counts crossings edge by edge.
_HOLLOW = [(0.125, 0.2), (0.55, 0.0625), (0.925, 0.35), (0.6, 0.5), (0.875, 0.8125), (0.3, 0.9375)]
_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_HOLLOW, _HOLLOW[1:] + _HOLLOW[:1]))


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), p AS (SELECT image_id, box_idx, xc AS px, yc AS py FROM ({O.BOXES})),
t AS (
  SELECT image_id, box_idx, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND x1 + (py - y1) * (x2 - x1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) > px) AS crossings,
         bool_or(abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 1e-3::DOUBLE * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
           AND (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) >= -1e-3::DOUBLE AND (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) <= (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + 1e-3::DOUBLE) AS edge
  FROM p, e GROUP BY 1, 2)
SELECT image_id, box_idx, edge OR crossings % 2 = 1 AS inside FROM t""")
def concave_zone(spark, d):
    b = G.box()
    return C.boxes(spark, d).select("image_id", "box_idx", P.inside(_HOLLOW, b.xc, b.yc).alias("inside"))


@query(f"""WITH {_ZONES}, p AS (SELECT *, xc AS fx, yc + h / 2 AS fy FROM ({O.BOXES}) WHERE cls = 0)
SELECT zone, count(*) FILTER (WHERE {_inside("fx", "fy")}) AS inside FROM p, zones GROUP BY zone""")
def zone_table_membership(spark, d):
    """The same by a table of zones, read at run time, and covered by cells."""
    people = C.boxes(spark, d).filter(F.col("cls") == G.PERSON)
    zones = zone.zone_table(spark)
    counts = zone.members(people, zones).groupBy("zone").agg(F.count("*").alias("n"))
    return zones.select("zone").join(counts, "zone", "left").select("zone", F.coalesce("n", F.lit(0)).alias("inside"))


_YARDS = """SELECT s_suppkey AS zone, list_transform([(-1, -1), (1, -1), (1, 1), (0, 0), (-1, 1)],
  lambda q: struct_pack(x := (100 + (s_suppkey * 37) % 800 + q[1] * (20 + (s_suppkey * 29) % 80))::DOUBLE / 1000::DOUBLE, y := (100 + (s_suppkey * 53) % 800 + q[2] * (20 + (s_suppkey * 29) % 80))::DOUBLE / 1000::DOUBLE)) AS points FROM supplier"""


@query(f"""WITH z AS ({_YARDS}), e AS (
  SELECT zone, points[i].x AS x1, points[i].y AS y1, points[i % 5 + 1].x AS x2, points[i % 5 + 1].y AS y2 FROM z, (SELECT unnest(range(1, 6)) AS i)),
p AS (SELECT image_id, box_idx, xc AS px, yc + h / 2 AS py FROM ({O.BOXES}) WHERE cls = 0),
t AS (
  SELECT zone, image_id, box_idx, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND x1 + (py - y1) * (x2 - x1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) > px) AS crossings,
         bool_or(abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 1e-3::DOUBLE * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
           AND (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) >= -1e-3::DOUBLE AND (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) <= (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + 1e-3::DOUBLE) AS edge
  FROM p, e GROUP BY ALL)
SELECT zone, count(*) AS people, count(DISTINCT image_id) AS images FROM t WHERE edge OR crossings % 2 = 1 GROUP BY zone""")
def zone_members(spark, d):
    """Who stands in which yard: a concave zone for each supplier, so that zones grow with the tables."""
    k, side = F.col("s_suppkey"), F.lit(20) + (F.col("s_suppkey") * 29) % 80
    point = lambda dx, dy: F.struct(((100 + (k * 37) % 800 + dx * side).cast("double") / 1000.0).alias("x"), ((100 + (k * 53) % 800 + dy * side).cast("double") / 1000.0).alias("y"))
    yards = table(spark, d, "supplier").select(k.alias("zone"), F.array(*(point(*q) for q in ((-1, -1), (1, -1), (1, 1), (0, 0), (-1, 1)))).alias("points"))
    people = C.boxes(spark, d).filter(F.col("cls") == G.PERSON)
    return zone.tally(people, yards, ["image_id"])


@query(f"""WITH {_DECIDED}, {_ZONES},
pz AS (SELECT b.image_id, b.box_idx AS person, zone FROM boxes b LEFT JOIN worn x ON x.image_id = b.image_id AND x.person = b.box_idx, zones
       WHERE b.cls = 0 AND NOT (coalesce(x.helmet, false) AND coalesce(x.vest, false)) AND {_inside("b.xc", "(b.yc + b.h / 2)")}),
wz AS (SELECT w.image_id, w.worker, zone, NOT (w.helmet AND w.vest) AS lacks, {_inside("w.xc", "(w.yc + w.h / 2)")} AS in_zone FROM workers w, zones),
j AS (SELECT wz.*, m.person, pz.person IS NOT NULL AS hit FROM wz LEFT JOIN matched m ON m.image_id = wz.image_id AND m.worker = wz.worker
      LEFT JOIN pz ON pz.image_id = m.image_id AND pz.person = m.person AND pz.zone = wz.zone),
c AS (SELECT zone, count(*) AS workers, count(*) FILTER (WHERE in_zone) AS workers_in_zone, count(*) FILTER (WHERE in_zone AND lacks) AS should_alert,
        count(*) FILTER (WHERE in_zone AND lacks AND hit) AS tp, count(*) FILTER (WHERE in_zone AND lacks AND NOT hit) AS fn,
        count(*) FILTER (WHERE in_zone AND lacks AND NOT hit AND person IS NULL) AS missed, count(*) FILTER (WHERE NOT (in_zone AND lacks) AND hit) AS fp_compliant FROM j GROUP BY zone),
u AS (SELECT zone, count(*) AS n FROM pz WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = pz.image_id AND m.person = pz.person) GROUP BY zone),
r AS (SELECT c.*, coalesce(u.n, 0) AS fp_unmatched FROM c LEFT JOIN u USING (zone)),
q AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp_compliant + fp_unmatched, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fp_compliant, 0), 0) AS precision_worker_level,
        coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM r)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""")
def zone_alert_confusion(spark, d):
    rows, crowd = _rows(spark, d)
    told = metrics.tell(rows, ["image_id"], crowd, F.col("first"))
    box = lambda c: G.Box(*(F.col(f"{c}.{f}") for f in G.Box._fields))
    alerting = F.col("person").isNotNull() & ~(F.col("wears_helmet") & F.col("wears_vest"))
    seen = told.select(
        F.col("worker").isNotNull().alias("own"),
        zone.zones_of(box("worker")).alias("standing"),
        # a function over an array keeps these columns out of whole-stage code, whose one method would be too long to be compiled by the JVM
        F.exists(F.array("worker.helmet", "worker.vest"), lambda worn: ~worn).alias("lacks"),
        F.when(alerting, zone.zones_of(box("person"))).otherwise(F.array().cast("array<string>")).alias("alerting"),
        F.col("person").isNotNull().alias("found"),
    )
    return metrics.zone_counts(seen, list(P.ZONES))


# confidences are percent, so the 99 thresholds from 0.01 on are 1 to 99
_TAUS = list(range(1, 100))
_SWEPT = f"""
taus AS (SELECT i::INT AS tau FROM range(1, 100) r(i)),
boxes AS (SELECT tau, b.*, tau * 1000000000::BIGINT + image_id AS ti FROM ({O.BOXES}) b, taus WHERE conf >= tau),
cand AS (SELECT i.ti, i.box_idx AS item, p.box_idx AS person, i.cls, {O.contain("i.", "p.")} AS score, {O.anchor("i.", "i.cls", "p.")} AS dist
  FROM boxes i JOIN boxes p ON i.ti = p.ti AND i.cls IN (1, 2) AND p.cls = 0 WHERE {O.contain("i.", "p.")} >= 0.8),
bound AS ({O.fold("cand", "ti", "score DESC, dist, item, person", ["item", "person", "cls"], "y.item = n[1].item OR (y.person = n[1].person AND y.cls = n[1].cls)")}),
workers AS (SELECT tau, w.*, tau * 1000000000::BIGINT + image_id AS ti FROM ({O.WORKERS}) w, taus),
mcand AS (SELECT w.ti, w.worker, p.box_idx AS person, {O.iou("p.", "w.")} AS score FROM workers w JOIN boxes p ON w.ti = p.ti AND p.cls = 0 WHERE {O.iou("p.", "w.")} >= 0.5),
matched AS ({O.fold("mcand", "ti", "score DESC, worker, person", ["worker", "person"], "y.worker = n[1].worker OR y.person = n[1].person")}),
j AS (SELECT w.tau, w.helmet, w.vest, m.person, x.cls FROM workers w LEFT JOIN matched m ON m.ti = w.ti AND m.worker = w.worker
      LEFT JOIN (SELECT ti, person, list(cls) AS cls FROM bound GROUP BY 1, 2) x ON x.ti = w.ti AND x.person = m.person),
axes AS (SELECT tau, 'helmet' AS axis, NOT helmet AS truth, person IS NOT NULL AS detected, person IS NOT NULL AND NOT coalesce(list_contains(cls, 1), false) AS flagged FROM j
  UNION ALL SELECT tau, 'vest', NOT vest, person IS NOT NULL, person IS NOT NULL AND NOT coalesce(list_contains(cls, 2), false) FROM j)
"""


@query(f"WITH {_SWEPT} SELECT axis, tau, {_CONFUSION} FROM axes GROUP BY axis, tau")
def roc_sweep(spark, d):
    return metrics.sweep_scenes(frames.scenes(C.rows(spark, d), ["image_id"], F.col("first")), _TAUS)


_GRID = "grid AS (SELECT (i * 5)::DOUBLE / 100 AS threshold FROM range(1, 20) r(i))"
_TRUE = f"""boxes AS ({O.BOXES}),
alone AS (SELECT image_id FROM boxes WHERE cls = 0 GROUP BY 1 HAVING count(*) = 1),
pos AS (SELECT i.image_id, i.box_idx AS item, i.cls, {O.contain("i.", "p.")} AS score FROM boxes i JOIN boxes p ON i.image_id = p.image_id AND p.cls = 0 AND i.cls IN (1, 2) JOIN alone a ON a.image_id = i.image_id)"""


@query(f"WITH {_TRUE}, {_GRID} SELECT cls, threshold, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS kept FROM pos, grid GROUP BY 1, 2")
def threshold_retention(spark, d):
    return calibrate.retention(calibrate.true_pairs(C.boxes(spark, d)), calibrate.grid(spark), ["cls"])


@query(f"""WITH {_TRUE}, b AS (SELECT p.*, {O.iou("i.", "q.")} AS iou FROM pos p JOIN boxes i ON i.image_id = p.image_id AND i.box_idx = p.item JOIN boxes q ON q.image_id = p.image_id AND q.cls = 0)
SELECT 'all' AS dataset, cls, count(*) AS pairs, list_sort(list(score))[count(*) // 2 + 1] AS median_score, round(avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END), 9) AS kept,
       list_sort(list(iou))[count(*) // 2 + 1] AS median_iou, round(avg(CASE WHEN iou >= 0.45 THEN 1.0 ELSE 0.0 END), 9) AS kept_iou, count(*) FILTER (WHERE score < 0.8) AS below FROM b GROUP BY cls""")
def calibration_report(spark, d):
    """The report's table of what the threshold keeps of true pairs, against the rule by overlap."""
    pairs = calibrate.true_pairs(C.boxes(spark, d)).withColumn("dataset", F.lit("all"))
    return reports.retained(kept(pairs, "true"), 0.8).withColumns({c: F.round(c, 9) for c in ("kept", "kept_iou")})


# false pairs: the people of images with items are numbered by a hash, and items draw a number by another
_HASH15 = lambda tag, i: f"md5('0{tag}|' || {i}image_id::VARCHAR || '|' || {i}box_idx::VARCHAR)"
_FALSE = f"""useful AS (SELECT image_id FROM boxes GROUP BY 1 HAVING count(*) FILTER (WHERE cls = 0) > 0 AND count(*) FILTER (WHERE cls IN (1, 2)) > 0),
pool AS (SELECT b.*, row_number() OVER (ORDER BY {_HASH15("p", "b.")}, b.image_id, b.box_idx) - 1 AS place, count(*) OVER () AS n FROM boxes b JOIN useful USING (image_id) WHERE cls = 0),
neg AS (
  SELECT i.image_id, i.box_idx AS item, {O.contain("i.", "p.")} AS score FROM boxes i JOIN useful USING (image_id)
  JOIN pool p ON p.place = ('0x' || substr({_HASH15("i", "i.")}, 1, 15))::BIGINT % (SELECT max(n) FROM pool)
  WHERE i.cls IN (1, 2) AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.image_id = i.image_id AND o.cls = 0 AND o.xc = p.xc AND o.yc = p.yc AND o.w = p.w AND o.h = p.h))"""
_SEPARATION = f"""{_TRUE}, {_FALSE}, {_GRID},
pc AS (SELECT cls, threshold, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END)::DOUBLE / count(*) AS k FROM pos, grid GROUP BY 1, 2),
nc AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END)::DOUBLE / count(*) AS k FROM neg, grid GROUP BY 1),
sep AS (SELECT g.threshold, (coalesce((SELECT k FROM pc WHERE cls = 1 AND pc.threshold = g.threshold), 1) + coalesce((SELECT k FROM pc WHERE cls = 2 AND pc.threshold = g.threshold), 1)) / 2
          - coalesce((SELECT k FROM nc WHERE nc.threshold = g.threshold), 1) AS separation FROM grid g)"""


@query(f"WITH boxes AS ({O.BOXES}), {_FALSE} SELECT image_id, item, score FROM neg")
def false_pairs(spark, d):
    return calibrate.false_pairs(C.boxes(spark, d))


def _separation(spark, d):
    boxes = C.boxes(spark, d)
    every = F.lit("all").alias("dataset")
    return calibrate.separation(calibrate.true_pairs(boxes).select(every, "cls", "score"), calibrate.false_pairs(boxes).select(every, "score"), calibrate.grid(spark))


@query(f"WITH {_SEPARATION} SELECT threshold, round(separation, 9) AS separation FROM sep")
def threshold_sweep(spark, d):
    return _separation(spark, d).withColumn("separation", F.round("separation", 9))


@query(f"""WITH {_SEPARATION}, r AS (SELECT threshold, round(separation, 9) AS separation FROM sep)
SELECT threshold, separation, threshold = (SELECT min(threshold) FROM r WHERE separation = (SELECT max(separation) FROM r)) AS chosen FROM r WHERE separation >= (SELECT max(separation) FROM r) - 0.01::DOUBLE""")
def plateau(spark, d):
    return calibrate.plateau(_separation(spark, d).withColumn("separation", F.round("separation", 9)))


@query(f"WITH {_TRUE}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score, image_id, item) AS rank FROM pos) SELECT cls, image_id, item, score, rank::INT AS rank FROM r WHERE rank <= 5")
def weakest_pairs(spark, d):
    return calibrate.weakest(calibrate.true_pairs(C.boxes(spark, d)), 5, ["cls"], ["image_id", "item"]).select("cls", "image_id", "item", "score", "rank")


@query(f"SELECT cls, count(*) AS n FROM ({O.BOXES}) GROUP BY cls")
def class_counts(spark, d):
    return audit.class_counts(C.boxes(spark, d))


@query(f"WITH c AS (SELECT DISTINCT image_id, cls FROM ({O.BOXES})) SELECT x.cls AS a, y.cls AS b, count(*) AS n FROM c x JOIN c y ON x.image_id = y.image_id AND x.cls <= y.cls GROUP BY 1, 2")
def cooccurrence(spark, d):
    return audit.cooccurrence(C.boxes(spark, d))


_CODED = f"(SELECT *, CASE WHEN helmet AND vest THEN 3 WHEN vest THEN 2 WHEN helmet THEN 1 ELSE 0 END AS code FROM ({O.WORKERS}))"
_CROSS = f"""per AS (
  SELECT w.image_id, w.worker, any_value(w.code) AS code, coalesce(bool_or(i.cls = 1 AND {O.contain("i.", "w.")} >= 0.5), false) AS has_helmet, coalesce(bool_or(i.cls = 2 AND {O.contain("i.", "w.")} >= 0.5), false) AS has_vest
  FROM {_CODED} w LEFT JOIN (SELECT * FROM ({O.BOXES}) WHERE cls <> 0) i ON i.image_id = w.image_id GROUP BY 1, 2),
cross_ AS (SELECT code, has_helmet, has_vest, count(*) AS n FROM per GROUP BY 1, 2, 3)"""


def _cross(spark, d):
    code = F.col("helmet").cast("int") + 2 * F.col("vest").cast("int")
    return audit.containment_table(C.workers(spark, d).withColumn("code", code), C.boxes(spark, d).filter("cls <> 0"), ["image_id"])


@query(f"WITH {_CROSS} SELECT * FROM cross_")
def containment_crosstab(spark, d):
    return _cross(spark, d)


@query(f"WITH {_CROSS} SELECT sum(CASE WHEN has_helmet = (code IN (1, 3)) AND has_vest = (code IN (2, 3)) THEN n ELSE 0 END)::BIGINT AS agreements, sum(n)::BIGINT AS total FROM cross_")
def mapping_agreement(spark, d):
    return audit.agreement(_cross(spark, d))


@query(f"""WITH o AS (SELECT image_id, box_idx AS obj_idx, 'c' || cls AS name, xc, yc, w, h FROM ({O.BOXES}) WHERE cls <> 0),
r AS (SELECT image_id, box_idx AS row_idx, cls, xc, yc, w, h FROM ({O.BOXES})),
d AS (SELECT r.image_id, r.row_idx, r.cls, o.name, row_number() OVER (PARTITION BY r.image_id, r.row_idx ORDER BY
  (o.xc - r.xc) * (o.xc - r.xc) + (o.yc - r.yc) * (o.yc - r.yc) + (o.w - r.w) * (o.w - r.w) + (o.h - r.h) * (o.h - r.h), o.obj_idx) AS nth FROM r JOIN o USING (image_id)),
v AS (SELECT cls, name, count(*) AS n, min(image_id * 1000 + row_idx) AS first FROM d WHERE nth = 1 GROUP BY 1, 2),
b AS (SELECT cls, name, n, n::DOUBLE / sum(n) OVER (PARTITION BY cls) AS purity, row_number() OVER (PARTITION BY cls ORDER BY n DESC, first, name) AS nth FROM v)
SELECT cls, name, n, purity FROM b WHERE nth = 1""")
def majority_vote(spark, d):
    box = ("xc", "yc", "w", "h")
    object_ = F.struct(F.col("box_idx").alias("obj_idx"), F.concat(F.lit("c"), F.col("cls").cast("string")).alias("name"), *box)
    both = C.boxes(spark, d).select("image_id", (F.col("box_idx") == 0).alias("first"), F.struct(F.col("box_idx").alias("row_idx"), "cls", *box).alias("row"), F.when(F.col("cls") != 0, object_).alias("object"))
    votes = assign.nearest_in(both, ["image_id"], F.col("first"))
    return audit.majority(votes.withColumn("first_at", F.col("image_id") * 1000 + F.col("row_idx")), ["cls"], "name", "first_at")


@query(f"SELECT cls, CASE WHEN w * h * 409600 < 1024 THEN 'small' WHEN w * h * 409600 < 9216 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n FROM ({O.BOXES}) GROUP BY 1, 2")
def coco_bins(spark, d):
    return C.boxes(spark, d).groupBy("cls", G.size_bin(G.box()).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""SELECT cls, count(*) AS n, round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS sd, round(quantile_cont(a, 0.05), 9) AS p5, round(quantile_cont(a, 0.5), 9) AS p50, round(quantile_cont(a, 0.95), 9) AS p95
FROM (SELECT cls, w * h AS a FROM ({O.BOXES})) GROUP BY cls""")
def describe_areas(spark, d):
    out = audit.describe(C.boxes(spark, d).withColumn("area", G.area(G.box())), "area", ["cls"])
    return out.select("cls", "n", *(F.round(c, 9).alias(c) for c in ("mean", "sd", "p5", "p50", "p95")))


@query(f"""WITH v AS (SELECT cls, conf, row_number() OVER (PARTITION BY cls ORDER BY conf) - 1 AS i, count(*) OVER (PARTITION BY cls) AS n FROM ({O.BOXES}))
SELECT cls, max(conf) FILTER (WHERE i = round_even(0.05 * (n - 1), 0)) AS p5, max(conf) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS p50, max(conf) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95 FROM v GROUP BY cls""")
def nearest_rank_percentile(spark, d):
    return audit.nearest_rank(C.boxes(spark, d), "conf", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ["cls"])


@query(f"WITH b AS (SELECT cls, least(floor(w * h / 0.05::DOUBLE), 9)::BIGINT AS bin, count(*) AS n FROM ({O.BOXES}) WHERE w * h >= 0 AND w * h <= 0.5 GROUP BY 1, 2) SELECT cls, bin, n, n / (sum(n) OVER (PARTITION BY cls) * 0.05::DOUBLE) AS density FROM b")
def area_histogram(spark, d):
    return audit.histogram(C.boxes(spark, d), G.area(G.box()), 0.0, 0.5, 10, ["cls"])


@query(f"SELECT cls, count(*) AS dropped FROM ({O.BOXES}) WHERE cls NOT IN (0, 1) GROUP BY cls")
def remap_dropped(spark, d):
    return audit.remap(C.boxes(spark, d), {0: 0, 1: 1})[1]


@query(f"SELECT image_id, box_idx, printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h) AS line FROM ({O.BOXES})")
def label_lines(spark, d):
    from ..sources.labels import label_line

    return C.boxes(spark, d).select("image_id", "box_idx", label_line(F.col("cls"), G.box()).alias("line"))


@query(f"SELECT image_id, box_idx, xc < 0 OR xc > 1 OR yc < 0 OR yc > 1 OR w < 0 OR w > 1 OR h < 0 OR h > 1 AS out FROM ({O.WORKERS.replace('box_idx AS worker', 'box_idx')})")
def out_of_range(spark, d):
    return C.workers(spark, d).select("image_id", F.col("worker").alias("box_idx"), G.out_of_range(G.box()).alias("out"))


@query(f"""WITH {_STATES}, z AS (SELECT *, {_inside("xc", "(yc + h / 2)")} AS in_zone FROM coded, (SELECT 0.25 AS x1, 0.0 AS y1, 0.75 AS x2, 1.0 AS y2))
SELECT CASE WHEN NOT in_zone THEN 'outside' WHEN helmet IS NULL OR vest IS NULL THEN 'breach' ELSE 'compliant' END AS verdict, count(*) AS n FROM z GROUP BY 1""")
def verdicts(spark, d):
    boxes = C.boxes(spark, d)
    states = assign.people_states(boxes, assign.bind(boxes))
    lacking = zone.missing(F.array(F.lit(1), F.lit(2)), F.array_compact(F.array(F.when(F.col("wears_helmet"), 1), F.when(F.col("wears_vest"), 2))))
    x, y = G.feet(G.box())
    inside = P.inside(P.ZONES["central-half"], x, y)
    return states.groupBy(zone.verdict(inside, lacking).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {_STATES}, z AS (
  SELECT *, {_inside("xc", "(yc + h / 2)")} AS in_zone, list_filter([CASE WHEN helmet IS NULL THEN 'helmet' END, CASE WHEN vest IS NULL THEN 'vest' END], lambda x: x IS NOT NULL) AS lacks,
         CASE WHEN conf < 50 THEN NULL ELSE person END AS track FROM coded, (SELECT 0.25 AS x1, 0.0 AS y1, 0.75 AS x2, 1.0 AS y2)),
b AS (SELECT image_id, track, lacks FROM z WHERE in_zone AND len(lacks) > 0)
SELECT image_id, count(*) AS in_breach, array_to_string(list('#' || track || ' no ' || array_to_string(lacks, ' or ') ORDER BY track)[1:3], '   ') AS shown FROM b WHERE track IS NOT NULL GROUP BY image_id""")
def breach_summary(spark, d):
    boxes = C.boxes(spark, d)
    states = assign.people_states(boxes, assign.bind(boxes))
    worn = F.array_compact(F.array(F.when(F.col("wears_helmet"), 1), F.when(F.col("wears_vest"), 2)))
    x, y = G.feet(G.box())
    people = states.select("image_id", F.col("person").alias("box_idx"), F.when(F.col("conf") >= 50, F.col("person")).alias("track_id"), worn.alias("worn"), P.inside(P.ZONES["central-half"], x, y).alias("in_zone"))
    tracked, _ = zone.assess(people, ["image_id"], F.array(F.lit(1), F.lit(2)))
    name = F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" no "), N.join_classes(F.col("missing"), " or "))
    names = F.transform(F.array_sort(F.collect_list(F.struct("track_id", name.alias("name")))), lambda v: v["name"])
    return tracked.groupBy("image_id").agg(F.count("*").alias("in_breach"), names.alias("names")).select("image_id", "in_breach", F.array_join(F.slice("names", 1, 3), "   ").alias("shown"))


@query(f"""WITH {_STATES}, z AS (SELECT *, {_inside("xc", "(yc + h / 2)")} AS inz FROM coded, (SELECT 0.25 AS x1, 0.0 AS y1, 0.75 AS x2, 1.0 AS y2))
SELECT image_id, count(*) AS people, count(*) FILTER (WHERE inz AND (helmet IS NULL OR vest IS NULL) AND conf < 50) AS untracked_violations, count(*) FILTER (WHERE inz) AS in_zone FROM z GROUP BY image_id""")
def frame_counts(spark, d):
    boxes = C.boxes(spark, d)
    states = assign.people_states(boxes, assign.bind(boxes))
    worn = F.array_compact(F.array(F.when(F.col("wears_helmet"), 1), F.when(F.col("wears_vest"), 2)))
    x, y = G.feet(G.box())
    people = states.select("image_id", F.col("person").alias("box_idx"), F.when(F.col("conf") >= 50, F.col("person")).alias("track_id"), worn.alias("worn"), P.inside(P.ZONES["central-half"], x, y).alias("in_zone"))
    return zone.assess(people, ["image_id"], F.array(F.lit(1), F.lit(2)))[1]


_FRAMES = f"""{_DROPPED},
left_ AS (SELECT b.* FROM boxes b LEFT JOIN dropped d USING (image_id, box_idx) WHERE d.box_idx IS NULL OR b.cls <> 0),
cand AS (SELECT i.image_id, i.box_idx AS item, p.box_idx AS person, i.cls, {O.contain("i.", "p.")} AS score, {O.anchor("i.", "i.cls", "p.")} AS dist
  FROM left_ i JOIN left_ p ON i.image_id = p.image_id AND i.cls IN (1, 2) AND p.cls = 0 WHERE {O.contain("i.", "p.")} >= 0.8),
bound AS ({O.fold("cand", "image_id", "score DESC, dist, item, person", ["item", "person", "cls"], "y.item = n[1].item OR (y.person = n[1].person AND y.cls = n[1].cls)")}),
worn AS (SELECT image_id, person, list(cls ORDER BY cls) AS worn FROM bound GROUP BY 1, 2)"""


@query(f"""WITH {_FRAMES} SELECT p.image_id, p.box_idx, coalesce(array_to_string(worn, '+'), '') AS worn, {_inside("p.xc", "(p.yc + p.h / 2)")} AS in_zone
FROM left_ p LEFT JOIN worn x ON x.image_id = p.image_id AND x.person = p.box_idx, (SELECT 0.25 AS x1, 0.0 AS y1, 0.75 AS x2, 1.0 AS y2) WHERE p.cls = 0""")
def frame_plan(spark, d):
    """Suppression, association and the zone in sequence, over frames of one row."""
    boxes = C.boxes(spark, d).withColumn("track_id", F.col("box_idx"))
    seen = frames.judged(frames.gather(boxes, ["image_id"], ["box_idx", "cls", "xc", "yc", "w", "h", "track_id"]), lambda x, y: P.inside(P.ZONES["central-half"], x, y))
    return seen.select("image_id", "box_idx", F.array_join(F.col("worn").cast("array<string>"), "+").alias("worn"), "in_zone")


@query("SELECT p_partkey, round_even(p_partkey % 97 / 96.0::DOUBLE * (100 + p_size), 0)::INT AS x1, round_even(p_size / 64.0::DOUBLE * 1001, 0)::INT AS y1 FROM part")
def zone_pixels(spark, d):
    """A zone of each row's own; its first corner in pixels."""
    from ..sources.tables import kept, table

    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = table(spark, d, "part")
    points = F.array(corner(F.col("p_partkey") % 97 / 96, F.col("p_size") / 64), corner(F.lit(1.0), F.lit(0.0)), corner(F.lit(1.0), F.lit(1.0)))
    return p.select("p_partkey", P.to_pixels(points, 100 + F.col("p_size"), F.lit(1001))[0].alias("at")).select("p_partkey", F.col("at.x").alias("x1"), F.col("at.y").alias("y1"))


_SAID = """n AS (SELECT p_partkey, ['', 'No_', 'no-', 'non-', 'Without ', 'head-no-', 'safety '][p_partkey % 7 + 1] || ['Helmet', 'hard_hat', 'HardHat', 'Vest', 'worker', 'People', 'glove', 'person'][p_partkey % 8 + 1] AS name FROM part),
m AS (SELECT *, replace(lower(name), '_', '-') AS low FROM n),
k AS (SELECT *, regexp_matches(low, '^(no-|non-|without)|no-') AS gone FROM m)"""


@query(f"""WITH {_SAID} SELECT p_partkey, name, CASE WHEN regexp_matches(low, 'helmet|hardhat|hard-hat') THEN CASE WHEN gone THEN 'no-helmet' ELSE 'helmet' END
WHEN contains(low, 'vest') THEN CASE WHEN gone THEN 'no-vest' ELSE 'vest' END WHEN regexp_matches(low, 'person|worker|people') THEN 'person' ELSE '- (extra / out of scope)' END AS core FROM k""")
def suggested_classes(spark, d):
    from ..sources.tables import kept, table

    heads, nouns = ["", "No_", "no-", "non-", "Without ", "head-no-", "safety "], ["Helmet", "hard_hat", "HardHat", "Vest", "worker", "People", "glove", "person"]
    pick = lambda words: F.get(F.array(*(F.lit(w) for w in words)), (F.col("p_partkey") % len(words)).cast("int"))
    named = table(spark, d, "part").select("p_partkey", F.concat(pick(heads), pick(nouns)).alias("name"))
    return named.withColumn("core", N.suggest_class(F.col("name")))
