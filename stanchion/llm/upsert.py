"""Copy-on-write keyed upsert of a table of sorted Parquet files, by positional deltas.

The table is a folder of files that are sorted by an integer key and follow one another. A change belongs to
its home, the last file that begins at or below its key, else the first. Only files that hold a change are
read. Their rows and the changes are dealt out by ranges of the key; in each piece of a range, searchsorted
places the changes among the rows, which gives three position vectors: rows to delete, rows to patch, and
places to insert at. New columns are built from these by `take`. Files whose rows then differ are written anew,
each as the fewest files of at most `rows_per_file` rows; then every rewritten file joins its left neighbour
if that was rewritten too and both fit. The others are left as they are, byte by byte.

A range of keys, not a file, is what a task holds, in pieces of PIECE rows. So neither a key with many
changes (they are reduced to one before any of this) nor a file that many new keys fall into fills a task.
What meets on the driver is the list of files (first and last key, rows): it is the table's metadata.
New files are written aside and moved in when all are complete; then the old ones go. A job that is lost
in between leaves the table as it was, or both forms of some files; a task that is lost is just run again.

Defined results: rows of a null key are never part of the table, and changes of a null key are ignored;
a key that several rows of the table share is patched or deleted in all of them; floats are equal if both
are NaN; without any file there is no home, and changes are ignored; deleting an absent key does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ._base import drop, keep, ragged, scratch, trimmed
from ._order import kept_numbered

PIECE = 1 << 16
_BASE, _SET, _DELETE = 0, 1, 2


class DataFile(NamedTuple):
    path: str
    first: int
    last: int
    rows: int


def new_table(spark: SparkSession, name: str = "table") -> str:
    """A new folder for a table, in the shared folder; it stays."""
    return scratch(spark, name)


def files_of(spark: SparkSession, folder: str, key: str, schema: StructType) -> list[DataFile]:
    """The table's files in key order, from the key column alone."""
    found = spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n"))
    return sorted((DataFile(f"{folder}/{r['name']}", r["a"], r["b"], r["n"]) for r in found.collect()), key=lambda f: (f.first, f.last, f.path))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _write_files(rows: DataFrame, folder: str, version: str) -> list[str]:
    """rows: no, at (orders), row (struct). One file of the folder for each no, in the order of `at`."""
    spark = rows.sparkSession
    names = {f.name.lower() for f in rows.schema["row"].dataType.fields}
    no = "_no"
    while no in names:
        no = "_" + no
    aside = scratch(spark, "aside")
    sorted_ = rows.repartition("no").sortWithinPartitions("no", "at").select(F.col("no").alias(no), "row.*")
    sorted_.write.partitionBy(no).parquet(aside)
    top, fs = _hadoop(spark, folder)
    fs.mkdirs(top)
    made = []
    for st in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/{no}=*/part-*")) or []:
        at = int(st.getPath().getParent().getName().split("=")[1])
        made.append(f"part-{at:06d}-{version}.parquet")
        if not fs.rename(st.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, made[-1])):
            raise OSError(f"{st.getPath()} cannot be moved to {folder}")
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return made


def create(df: DataFrame, folder: str, key: str, rows_per_file: int) -> None:
    """Writes df, sorted by key, as files of rows_per_file rows (the last: the rest). Rows of one key are in the order of their columns."""
    plain = [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, ArrayType | MapType | StructType)]
    order = [F.col("key"), *(F.col("row").getField(c) for c in plain)]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    placed = kept_numbered(rows, order, "at")
    _write_files(placed.select(F.floor(F.col("at") / rows_per_file).cast("int").alias("no"), "at", "row"), folder, "0")
    drop(placed)


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the change that is last by `order` (nulls first); exact ties go by the other columns. Reduced before it is shuffled."""
    cols = [*order, *(c for c in changes.columns if c not in order)]
    last = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("change"))
    return last


def _at_home(firsts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.maximum(np.searchsorted(firsts, batch.column(0).to_numpy(), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home, pa.int32()), pa.array(firsts[home]), batch.column(1)], ["key", "home", "first", "change"])

    return run


def _same(old: pa.Array, new: pa.Array) -> np.ndarray:
    """Where values are equal, nulls and NaN alike."""
    try:
        same = pc.equal(old, new)
    except pa.ArrowNotImplementedError:
        return np.fromiter((a == b for a, b in zip(old.to_pylist(), new.to_pylist())), bool, len(old))
    same = pc.or_(pc.fill_null(same, False), pc.and_(old.is_null(), new.is_null()))
    if pa.types.is_floating(old.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(old), pc.is_nan(new)), False))
    return same.to_numpy(zero_copy_only=False)


def delta(kind: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position vectors of sorted rows and changes that stand in one array: (take, patch, gone).

    take: the position of each new row; patch: the position of the change that patches it, else its own;
    gone: positions of deleted rows.
    """
    base, change = np.flatnonzero(kind == _BASE), np.flatnonzero(kind != _BASE)
    lo, hi = (np.searchsorted(key[base], key[change], side) for side in ("left", "right"))
    hits, deletes = hi - lo, kind[change] == _DELETE
    kept = np.ones(len(base), bool)
    kept[ragged(lo[deletes], hits[deletes])] = False
    patch = base.copy()
    sets = ~deletes & (hits > 0)
    patch[ragged(lo[sets], hits[sets])] = np.repeat(change[sets], hits[sets])
    new = ~deletes & (hits == 0)
    at = np.concatenate(([0], np.cumsum(kept)))[lo[new]]
    return np.insert(base[kept], at, change[new]), np.insert(patch[kept], at, change[new]), base[~kept]


def _merged(columns: list[str], sets: list[str], piece: int):
    """Rows sorted by key -> the new rows (home, slice, at, row), and one line for each home in a slice (home, slice, n, changed)."""

    def answer(t: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        kind, key, home = (t[c].to_numpy() for c in ("kind", "key", "home"))
        take, patch, gone = delta(kind, key)
        row = t["row"].combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        old = row.flatten()
        patched = np.flatnonzero(patch != take)
        differs = np.zeros(len(take), bool)
        differs[kind[take] != _BASE] = True
        new = []
        for name, column in zip(columns, old):
            new.append(column.take(pa.array(patch if name in sets else take)))
            if name in sets and len(patched):
                differs[patched] |= ~_same(column.take(pa.array(take[patched])), column.take(pa.array(patch[patched])))
        homes, n = np.unique(home[take], return_counts=True)
        every, changed = np.unique(np.concatenate((home[take[differs]], home[gone])), return_counts=True)
        at = np.arange(len(take)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(take) else np.empty(0, np.int64)
        row_type = row.type
        seen = np.union1d(homes, every)
        tell = [dict(zip(homes.tolist(), n.tolist())), dict(zip(every.tolist(), changed.tolist()))]
        data = [pa.array(home[take], pa.int32()), pa.array(np.full(len(take), number)), pa.array(at, pa.int64()), pa.nulls(len(take), pa.int64()), pa.nulls(len(take), pa.int64()), pa.StructArray.from_arrays(new, fields=list(row_type))]
        line = [pa.array(seen, pa.int32()), pa.array(np.full(len(seen), number)), pa.nulls(len(seen), pa.int64()), *(pa.array([x.get(h, 0) for h in seen.tolist()], pa.int64()) for x in tell), pa.nulls(len(seen), row_type)]
        names = ["home", "slice", "at", "n", "changed", "row"]
        yield pa.RecordBatch.from_arrays(data, names)
        yield pa.RecordBatch.from_arrays(line, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= piece:
                whole = pa.concat_tables(held)
                key = whole["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if cut:
                    yield from answer(whole.slice(0, cut), number)
                    number += 1
                held = [whole.slice(cut)]
        if held:
            yield from answer(pa.concat_tables(held), number)

    return run


class Plan(NamedTuple):
    """How rewritten files are cut: of each home the size of its smaller pieces, how many are one larger, and each piece's new file."""

    homes: list[tuple[int, int, int, list[int]]]
    files: int


def plan(rows: dict[int, int], homes: int, rows_per_file: int) -> Plan:
    """rows: the number of rows of each home that is rewritten. Pieces are joined to the left as far as they fit."""
    out, at, left = [], -1, None  # left: rows of the last file if it is a rewritten one
    for h in range(homes):
        if h not in rows:
            left = None
            continue
        n = rows[h]
        k = -(-n // rows_per_file)
        target = []
        for i in range(k):
            size = n // k + (i < n % k)
            if left is not None and left + size <= rows_per_file:
                left += size
            else:
                at, left = at + 1, size
            target.append(at)
        out.append((h, n // k if k else 0, n % k if k else 0, target))
    return Plan(out, at + 1)


def upsert(folder: str, changes: DataFrame, action: Callable[[Column, Column], Column], schema: StructType, key: str, sets: list[str], rows_per_file: int) -> list[str]:
    """Applies changes to the table in the folder and returns the names of the files it wrote.

    changes: key (long, each once), change (struct). action(first, change) tells of each change, given the first key of its
    home, what it does: 'set' sets the columns `sets`, 'delete' deletes, anything else ignores it.
    """
    spark = changes.sparkSession
    files = files_of(spark, folder, key, schema)
    if not files:
        return []
    change_type = changes.schema["change"].dataType
    at_home = changes.mapInArrow(trimmed(_at_home(np.array([f.first for f in files], np.int64))), StructType().add("key", "long").add("home", "integer").add("first", "long").add("change", change_type))
    acts = at_home.withColumn("act", action(F.col("first"), F.col("change"))).filter(F.col("act").isin("set", "delete"))
    field = lambda f: F.col("change").getField(f.name) if f.name in sets else (F.col("key") if f.name == key else F.lit(None))
    row = F.struct(*(field(f).cast(f.dataType).alias(f.name) for f in schema.fields))
    kind = F.when(F.col("act") == "set", _SET).otherwise(_DELETE)
    acts = keep(acts.select("key", kind.alias("kind"), "home", F.lit(-1).cast("long").alias("nth"), row.alias("row")), "acts")
    touched = {r.home for r in acts.select("home").distinct().collect()}
    for h in range(len(files) - 1, 0, -1):  # a key may have begun in the file before
        if h in touched and files[h - 1].last == files[h].first:
            touched.add(h - 1)
    if not touched:
        return []
    known = spark.createDataFrame([(files[h].path.rsplit("/", 1)[1], h) for h in sorted(touched)], "file string, home int")
    base = spark.read.schema(schema).parquet(*(files[h].path for h in sorted(touched)))
    base = base.select(F.col(key).cast("long").alias("key"), F.lit(_BASE).alias("kind"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"), F.struct(*(F.col(f"`{c}`") for c in schema.names)).alias("row"))
    base = base.join(F.broadcast(known), "file").select("key", "kind", "home", "nth", "row")
    both = base.unionByName(acts).repartitionByRange("key").sortWithinPartitions("key", "kind", "home", "nth")
    out = StructType().add("home", "integer").add("slice", "long").add("at", "long").add("n", "long").add("changed", "long").add("row", both.schema["row"].dataType)
    merged = keep(both.select("key", "kind", "home", "row").mapInArrow(trimmed(_merged(schema.names, sets, PIECE)), out), "merged")

    lines = merged.filter("n IS NOT NULL").select("home", "slice", "n", "changed")
    totals = lines.groupBy("home").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed")).filter("changed > 0").collect()
    told = plan({r.home: r.n for r in totals}, len(files), rows_per_file)
    made: list[str] = []
    if told.files:
        pieces = F.broadcast(spark.createDataFrame(told.homes, "home int, size long, larger long, target array<int>"))
        upto = F.sum("n").over(_by_home()) - F.col("n")
        starts = lines.withColumn("start", upto).select("home", "slice", "start")
        rows = merged.filter("at IS NOT NULL").select("home", "slice", "at", "row").join(starts, ["home", "slice"]).join(pieces, "home")
        pos = F.col("start") + F.col("at")
        wide = F.col("larger") * (F.col("size") + 1)
        piece = F.when(pos < wide, F.floor(pos / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((pos - wide) / F.greatest("size", F.lit(1))))
        rows = rows.select(F.get("target", piece.cast("int")).alias("no"), F.struct("home", pos.alias("pos")).alias("at"), "row")
        made = _write_files(rows, folder, uuid.uuid4().hex[:8])
    _, fs = _hadoop(spark, folder)
    for r in totals:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(files[r.home].path), False)
    drop(acts, merged)
    return made


def _by_home():
    from pyspark.sql import Window

    return Window.partitionBy("home").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
