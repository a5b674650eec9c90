"""Scans of JSON, CSV, YAML-like and README documents, and of model files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, model string, trained_on string, seed int, in_domain map<string,double>, cross_domain map<string,double>"


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """(cls, name) of lines like `3: vest`."""
    form = r"^\s*(\d+)\s*:\s*(.+?)\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).cast("int").alias("cls"), F.regexp_extract("value", form, 2).alias("name"))


def read_run_scores(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, model, trained_on, seed, tested, metric, value) of one JSON document per run; path may be a glob."""
    runs = spark.read.schema(RUN).option("multiLine", True).json(path)
    side = lambda c: runs.select("run_id", "model", "trained_on", "seed", F.lit(c).alias("tested"), F.explode(c).alias("metric", "value"))
    return side("in_domain").unionByName(side("cross_domain"))


def read_hashes(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, stem, hash) of a JSON object from stem to an unsigned 64-bit number, as a signed one."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,decimal(20,0)>")).alias("stem", "n"))
    half, whole = F.lit("9223372036854775807").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = F.when(F.col("n") > half, F.col("n") - whole).otherwise(F.col("n"))
    return rows.select(F.lit(dataset).alias("dataset"), "stem", signed.cast("long").alias("hash"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A run's log; rows without an epoch go, unreadable numbers are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c: c.strip() for c in raw.columns}
    out = raw.select(*(F.trim(F.col(f"`{c}`")).try_cast("double").alias(n) for c, n in names.items()))
    return out.filter("epoch is not null").withColumn("epoch", F.col("epoch").cast("int"))


def read_predictions(spark: SparkSession, path: str, at_least: float = 0.0) -> DataFrame:
    """Boxes of a Parquet folder partitioned by run; the confidence bound reaches the scan."""
    return spark.read.parquet(path).filter(F.col("conf") >= at_least)


def flatten_ragged(caches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, image, width, height, box_idx, cls, xc, yc, w, h, conf) of ragged caches, one row each: names, counts, sizes (arrays of
    width and height) and boxes (all images' one after another, six numbers each). Counts that do not add up raise."""
    by = by or []
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, n: acc + n)
    message = F.concat(F.lit("counts give "), total.cast("string"), F.lit(" boxes, there are "), F.size("boxes").cast("string"))
    whole = (total == F.size("boxes")) & (F.size("names") == F.size("counts")) & (F.size("names") == F.size("sizes"))
    # each image once for each of its boxes, in their order: as long as the boxes, whatever a cache holds, and no row carries all boxes
    own = lambda m: F.transform(F.array_repeat(m, m.counts.cast("int")), lambda m, i: F.struct(m.names.alias("image"), m.sizes.alias("size"), i.alias("box_idx")))
    images = F.flatten(F.transform(F.arrays_zip("names", "counts", "sizes"), own))
    checked = F.when(whole, F.arrays_zip(images.alias("_m"), F.col("boxes").alias("_b"))).otherwise(F.raise_error(message))
    rows = caches.select(*by, F.inline(checked)).select(*by, F.col("_m.image").alias("image"), F.get("_m.size", F.lit(0)).cast("int").alias("width"), F.get("_m.size", F.lit(1)).cast("int").alias("height"), F.col("_m.box_idx").alias("box_idx"), "_b")
    value = [F.get("_b", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("xc", "yc", "w", "h", "conf"), 1)]
    return rows.select(*by, "image", "width", "height", "box_idx", F.get("_b", F.lit(0)).cast("int").alias("cls"), *value)


def parse_document(text: str) -> dict:
    """A mapping from JSON or YAML text; where no YAML reader is installed, from JSON or lines `key: value`."""
    if not text.strip():
        return {}
    try:
        import yaml

        given = yaml.safe_load(text)
    except ImportError:
        given = _flat(text)
    if not isinstance(given, dict):
        raise ValueError("the document is no mapping")
    return given


def _flat(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        pass
    given = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].rstrip()
        if line:
            key, _, value = line.partition(":")
            try:
                given[key.strip()] = json.loads(value)
            except ValueError:
                given[key.strip()] = value.strip()
    return given


def read_config(text: str, defaults: dict, overrides: dict | None = None) -> tuple[dict, list[str]]:
    """A configuration document (JSON or YAML), checked against the keys of defaults, also inside values that are mappings with
    defaults of their own; and notes of what was overridden."""

    def merged(given: dict, usual: dict, at: str) -> dict:
        unknown = sorted(set(given) - set(usual))
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(at + k for k in unknown)}")
        deep = {k: merged(v, usual[k], f"{at}{k}.") for k, v in given.items() if isinstance(v, dict) and isinstance(usual[k], dict) and usual[k]}
        return usual | given | deep

    out = merged(parse_document(text), defaults, "")
    notes = [f"{k}: {out[k]} -> {v}" for k, v in (overrides or {}).items() if v is not None and v != out[k]]
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}, notes


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """(zone, points) of files of zone documents, one for each line; one without points is an error, one without a name has its file's."""
    docs = spark.read.text(path).filter(F.trim("value") != "")
    read = docs.select(F.from_json("value", "name string, points array<array<double>>").alias("d"), F.regexp_extract("_metadata.file_name", r"([^/.]+)[^/]*$", 1).alias("_file"))
    points = F.when(F.size("d.points") > 0, F.transform("d.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    points = F.coalesce(points, F.raise_error(F.lit("no zone: it has no points")).cast("array<struct<x:double,y:double>>"))
    return read.select(F.coalesce("d.name", "_file").alias("zone"), points.alias("points"))


def list_models(spark: SparkSession, glob: str, recommended: str | None = None) -> DataFrame:
    """(run_id, path, recommended) of files <run>/weights/best.*."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    run = F.regexp_extract("path", r"([^/]+)/weights/[^/]+$", 1)
    return files.select(run.alias("run_id"), "path", (run == F.lit(recommended or "")).alias("recommended")).filter("run_id <> ''")
