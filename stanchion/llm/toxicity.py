"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (GRAMS characters of the text, A-Z lower-cased) of a document,
hashed into 2**BITS places. From a bounded sample of labelled rows (SAMPLE of each label, by a hash of
the id), document counts by label give each feature's log-count ratio r; the FEATURES places of
highest chi-square are kept. A logistic regression is fitted to the 0/1 features times r. What
is broadcast for scoring is a table of fixed size. Scoring is one narrow pass over all rows.

Labels of rows with crc32(id as text) mod FOLDS = 0 are never used; label, language, source and
id are no inputs of a score.

Defined results: null text counts as empty and gets the score that no n-grams give; a score of exactly
0.5 is toxic; a row with a null id is scored and not held out; with no
toxic or no clean labelled row nothing can be learned and every score is 0; labels that are
null count for nothing, and of several labels of an id the largest holds; every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._base import LOWER, chunks, drop, keep, pack, pack_sorted, parts, release, small_batches, strings, trimmed, unpack, unpack_sorted

GRAMS, BITS = (3, 4, 5), 22
#: Kept features, and the penalty: chosen by cross-validation inside the rows that may be learned from (folds 1 to 4 of FOLDS).
FEATURES, L2 = 1024, 3.0
#: At most so many labelled rows of each label are learned from.
SAMPLE = 10_000
FOLDS, STEPS = 5, 300
_P = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def _characters(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the bounds of each document's."""
    if not len(body) or body.max() < 0x80:
        return body.astype(np.uint32), offsets
    heads = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
    return np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets]


def _places(own: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: every gram's place, and whether it is whole (grams across documents are not)."""
    own = own + np.uint32(1)
    g = own.copy()
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for k in range(2, max(GRAMS) + 1):
        if len(own) < k:
            return
        g = g[:-1] * _P + own[k - 1 :]
        if k in GRAMS:
            h = (g ^ (g >> np.uint32(15))) * _SPREAD
            yield (h * np.uint32(2 * k + 1)) >> np.uint32(32 - BITS), ends[: len(g)] - np.arange(len(g)) >= k


def _distinct(body: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place), in order; with a table, only places that have a number there, and the numbers."""
    body, offsets = _characters(body, offsets)
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = []
    for place, whole in _places(body, offsets):
        if table is not None:
            at = np.flatnonzero((table[place] >= 0) & whole)
            keys.append((docs[at].astype(np.int64) << BITS) | table[place[at]])
        else:
            keys.append((docs[: len(place)][whole].astype(np.int64) << BITS) | place[whole])
    k = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    return k >> BITS, k & ((1 << BITS) - 1)


@dataclass
class Model:
    table: np.ndarray  # place -> feature number or -1
    weights: np.ndarray  # feature -> weight times log-count ratio
    bias: float

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = _distinct(LOWER[body], offsets, self.table)
        z = np.bincount(doc, self.weights[feature], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each place, by label; packed."""
    n = np.zeros((2, 1 << BITS), np.uint32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column(1).to_numpy()
        rows += np.bincount(y, minlength=2)
        data, offsets = strings(batch.column(0))
        for lo, hi, body, offs in chunks(data, offsets):
            doc, place = _distinct(LOWER[body], offs)
            for label in (0, 1):
                at, times = np.unique(place[y[lo + doc] == label], return_counts=True)
                n[label][at] += times.astype(np.uint32)
    for label in (0, 1):
        at = np.flatnonzero(n[label]).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([int(rows[label])], pa.int64()), pa.array([pack_sorted(at)], pa.binary()), pa.array([pack(n[label][at])], pa.binary())], ["label", "rows", "places", "counts"])


def _fit(doc: np.ndarray, feature: np.ndarray, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by Nesterov steps of a size that the curvature bounds."""
    n, m = len(y), len(r)
    x = r[feature]
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    # a step is safe below four over the largest eigenvalue of x'x, found by power iterations
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        u = np.bincount(feature, x * np.bincount(doc, x * v[feature], n)[doc], m)
        top = np.linalg.norm(u)
        v = u / max(top, 1e-12)
    step = 1 / (0.25 * (top + n) + L2)
    pw, pb = w, b
    for t in range(STEPS):
        c = t / (t + 3)
        aw, ab = w + c * (w - pw), b + c * (b - pb)
        z = np.bincount(doc, x * aw[feature], n) + ab
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        pw, pb = w, b
        w = aw - step * (np.bincount(feature, x * g[doc], m) + L2 * aw)
        b = ab - step * g.sum()
    return w, b


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is never learned from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from the labelled rows of docs outside the held-out fold; None where one label has no row."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    own = own.filter("id is not null and y in (0, 1)").filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    few = [own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * SAMPLE rows of two numbers
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = keep(text.join(chosen, "id").select("id", "text", "y"), "labelled")

    n, rows = np.zeros((2, 1 << BITS), np.uint32), np.zeros(2)
    few_parts = min(8, parts(docs.sparkSession))
    for r in sample.select("text", "y").coalesce(few_parts).mapInArrow(trimmed(_counts), "label int, rows long, places binary, counts binary").collect():
        rows[r.label] += r["rows"]
        n[r.label][unpack_sorted(r.places, np.uint32)] += unpack(r.counts, np.uint32)
    if not rows.all():
        drop(sample)
        return None
    total = n.sum(1, dtype=np.float64) + n.shape[1]
    seen = np.flatnonzero(n[0] + n[1] >= 3)
    q, p = n[:, seen].astype(np.float64)
    del n
    ratio = np.log((p + 1) / total[1]) - np.log((q + 1) / total[0])
    share = (p + q) / rows.sum()
    apart = (p / rows[1] - q / rows[0]) ** 2 / np.maximum(share * (1 - share), 1e-12)
    best = np.argsort(-apart, kind="stable")[:FEATURES]
    best = np.sort(best[apart[best] > 0])
    ratio, best = ratio[best], seen[best]
    table = np.full(1 << BITS, -1, np.int16)
    table[best] = np.arange(len(best))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            out = []
            for _, _, body, offs in chunks(data, offsets):
                doc, feature = _distinct(LOWER[body], offs, table)
                c = np.searchsorted(doc, np.arange(len(offs)))
                out += [pack(feature[a:b].astype(np.uint16)) for a, b in zip(c, c[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["id", "y", "features"])

    got = sorted(sample.mapInArrow(trimmed(present), "id long, y int, features binary").collect())
    drop(sample)
    features = [unpack(r.features, np.uint16).astype(np.int64) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(x) for x in features])
    w, b = _fit(doc, np.concatenate(features) if features else np.empty(0, np.int64), ratio, np.array([r.y for r in got], float))
    release()
    return Model(table, w * ratio, b)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """All columns of docs and the score as `name`, which docs may not have already; rows keep their place."""
    small_batches(docs.sparkSession)
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {name}: give another name for the score")
    if model is None:
        return docs.select("*", F.lit(0.0).alias(name))
    held = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    plain = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            s = [held.value.scores(body, offs) for _, _, body, offs in chunks(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.empty(0))], ["row", "score"])

    kind = StructType([plain.schema["row"], StructField("score", DoubleType())])
    return plain.mapInArrow(trimmed(run), kind).select("row.*", F.col("score").alias(name))
