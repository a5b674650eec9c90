"""Token-ID output: documents as id arrays, each compressed alone with one shared zstandard dictionary.

Texts are dealt out by ranges of the id, sorted, encoded and packed into shards; a shard is one
self-describing binary value, so Spark's writers commit it, in any store:

    magic "TKS1" | ids' width in bytes u8 | documents u32 | dictionary hash u64
    | document ids i64[n] | id counts u32[n] | frame offsets u64[n+1] | frames

A frame is the zstandard frame of a document's ids, little-endian. The offset index gives one
document without decompressing others. The table holds shards of ids in ascending order:
part, seq, first_id, last_id, n_docs, n_tokens, start (ids before it in its part), shard.
The dictionary is trained on the first SAMPLE_BYTES of the id arrays of SAMPLE documents of any length, chosen
by a hash of the id; where these are too few to train on, they serve as the dictionary themselves.
It is kept beside the shards and its hash checked on reading. It affects sizes only.

Encoding goes by units: white space and the run of other characters after it. The tokenizer's
pattern always splits before a unit, so a unit's ids depend on the unit alone, and a worker
remembers those of units it has met. Documents with other Unicode white space or control characters,
where that would not hold, are encoded whole.

Defined results: null text is empty and has just the end id; rows that share an id stand next
to each other, ordered by text; a null id comes first; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import U64, WHITE, Words, parts, ragged, scratch, small_batches, strings, trimmed

END, SAMPLE, DICT_BYTES, SHARD_BYTES, LEVEL = 2, 2000, 1 << 16, 1 << 20, 3
#: Bytes of each sampled document's ids; with SAMPLE the bound of what the driver trains on (16 MB).
SAMPLE_BYTES = 1 << 13
MAGIC = b"TKS1"
#: Units whose ids a process remembers (about 50 bytes each).
MOST_UNITS = 1_000_000
_LIVE: dict[str, object] = {}
_UNITS: dict[str, "Units"] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per process, on one thread."""
    if path not in _LIVE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        size = np.zeros(t.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in t.get_vocab(with_added_tokens=True).items():
            size[i] = len(piece)  # byte-level pieces have one character for each byte
        _LIVE[path] = t, size
    return _LIVE[path]


def units_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """White space with what follows it, up to the next white space; units tile every document."""
    n = len(data)
    white = WHITE[data]
    head = np.zeros(n, bool)
    if n:
        head[1:] = white[1:] & ~white[:-1]
        head[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(head)
    return Words(data, starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets))


def odd_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold white space or separators outside ASCII's six, by conservative byte patterns."""
    far = np.append(data, np.zeros(3, np.uint8))
    lead = np.flatnonzero(((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    a, b, c = far[lead], far[lead + 1], far[lead + 2]
    on = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
    on |= ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, lead[on], "right") - 1] = True
    return out


class Units:
    """Ids of units met before in this process, by 64-bit hash; at most MOST_UNITS, of which those met again stay longest."""

    def __init__(self):
        self.keys = np.empty(0, U64)
        self.at, self.counts, self.again = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.pool = np.empty(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        on = self.keys[at] == keys
        self.again[at[on]] = True
        return np.where(on, at, -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """keys are new and ascend; ids of each, one after another."""
        if len(self.keys) + len(keys) > MOST_UNITS:
            on = self.again if self.again.sum() < MOST_UNITS // 2 else np.zeros(len(self.keys), bool)
            self.pool = self.pool[ragged(self.at[on], self.counts[on])]
            self.keys, self.counts = self.keys[on], self.counts[on]
            self.at, self.again = np.cumsum(self.counts) - self.counts, np.zeros(int(on.sum()), bool)
        put = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, put, len(self.pool) + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, put, counts)
        self.again = np.insert(self.again, put, False)
        self.keys = np.insert(self.keys, put, keys)
        self.pool = np.concatenate((self.pool, ids.astype(np.int32)))


def _encode_units(tok, size: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of data[s:e] for each s, e, one after another, and their counts. Units that white space begins go together."""
    white = np.append(WHITE[data], False)
    joins = white[s] & ~white[e - 1]
    lone, joint = np.flatnonzero(~joins), np.flatnonzero(joins)
    counts, at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    ids, total = [np.empty(0, np.int64)], 0
    if len(joint):
        lengths = (e - s)[joint]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        cut = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], 1 << 12)), len(joint)))
        raw = data[ragged(s[joint], lengths)].tobytes()
        pieces = [raw[bounds[a] : bounds[b]].decode() for a, b in zip(cut, cut[1:])]
        got = np.concatenate([np.array(x.ids, np.int64) for x in tok.encode_batch_fast(pieces, add_special_tokens=False)])
        ends = np.concatenate(([0], np.cumsum(size[got])))
        split = np.searchsorted(ends, bounds)
        if ends[-1] != bounds[-1] or (ends[split] != bounds).any():
            raise ValueError("the tokenizer joined two units; its pattern is not one that splits before white space")
        counts[joint], at[joint] = np.diff(split), split[:-1]
        ids.append(got)
        total = len(got)
    if len(lone):
        texts = [data[a:b].tobytes().decode() for a, b in zip(s[lone], e[lone])]
        for i, x in zip(lone, tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids.append(np.array(x.ids, np.int64))
            counts[i], at[i] = len(x.ids), total
            total += len(x.ids)
    return np.concatenate(ids)[ragged(at, counts)], counts


def encode_chunk(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a chunk, and the bounds of each one's."""
    tok, size = tokenizer(path)
    known = _UNITS.setdefault(path, Units())
    n_docs = len(offsets) - 1
    u = units_of(data, offsets)
    keys, first, which = np.unique(u.hashes(), return_index=True, return_inverse=True)
    at = known.find(keys)
    new = np.flatnonzero(at < 0)
    ids, got = _encode_units(tok, size, data, u.starts[first[new]], u.ends[first[new]])
    counts, start = known.counts[at] if len(known.counts) else np.zeros(len(keys), np.int64), known.at[at] if len(known.at) else np.zeros(len(keys), np.int64)
    counts[new], start[new] = got, len(known.pool) + np.cumsum(got) - got
    pool = np.concatenate((known.pool, ids))
    if len(new) <= MOST_UNITS // 2:
        known.add(keys[new], ids, got)
    c = counts[which]
    out = pool[ragged(start[which], c)].astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(c)))[u.first]
    odd = np.flatnonzero(odd_documents(data, offsets))
    if len(odd):
        whole = tok.encode_batch_fast([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd], add_special_tokens=False)
        rows = [out[bounds[i] : bounds[i + 1]] for i in range(n_docs)]
        for i, x in zip(odd, whole):
            rows[i] = np.array(x.ids, np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        out = np.concatenate(rows)
    return out, bounds


def _train(arrays: list[bytes]) -> bytes:
    """Dictionary bytes; with too little to train on, the arrays themselves serve as one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[:DICT_BYTES]


def pack_shard(docs: list[int], counts: list[int], frames: list[bytes], width: int, dict_hash: int) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.int64))).astype("<u8")
    head = MAGIC + bytes([width]) + len(docs).to_bytes(4, "little") + dict_hash.to_bytes(8, "little")
    return b"".join([head, np.array(docs, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """A shard's index, and its documents on demand."""

    def __init__(self, raw: bytes, dictionary: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        n = int.from_bytes(raw[5:9], "little")
        if int.from_bytes(raw[9:17], "little") != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.kind = f"<u{raw[4]}"
        at = 17
        self.docs = np.frombuffer(raw, "<i8", n, at)
        self.counts = np.frombuffer(raw, "<u4", n, at + 8 * n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, at + 12 * n).astype(np.int64) + at + 12 * n + 8 * (n + 1)
        self.raw = raw
        self.z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.z.decompress(self.raw[self.offsets[i] : self.offsets[i + 1]]), self.kind)


SHARDS = "part int, seq int, first_id long, last_id long, n_docs long, n_null long, n_tokens long, start long, shard binary"


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as shards to out/shards and the dictionary to out/dictionary."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _, size = tokenizer(tokenizer_path)
    kind = "<u2" if max(len(size), end_id + 1) <= 1 << 16 else "<u4"
    few = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, bounds = encode_chunk(tokenizer_path, *strings(batch.column(1)))
            most = SAMPLE_BYTES // int(kind[-1])
            own = [np.append(got[a:b], end_id)[:most].astype(kind).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["doc_id", "head"])

    # of rows that share an id one is taken, so that the bound holds
    chosen = base.join(F.broadcast(few), "doc_id").mapInArrow(trimmed(heads), "doc_id long, head binary").groupBy("doc_id").agg(F.min("head").alias("head"))
    dictionary = _train([bytes(r["head"]) for r in sorted(chosen.collect())])
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        told, width = xxhash.xxh64_intdigest(d), int(kind[-1])
        part, seq, start, ended = TaskContext.get().partitionId(), 0, 0, np.array([end_id], kind)
        ids, counts, frames, held, nulls = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            n = sum(counts)
            row = (part, seq, ids[0], ids[-1], len(ids), nulls, n, start, pack_shard(ids, counts, frames, width, told))
            types = [pa.int32(), pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["part", "seq", "first_id", "last_id", "n_docs", "n_null", "n_tokens", "start", "shard"])

        for batch in batches:
            data, offsets = strings(batch.column(1))
            keys = batch.column(0).to_pylist()
            got, bounds = encode_chunk(tokenizer_path, data, offsets)
            got = got.astype(kind)
            for i, key in enumerate(keys):
                own = np.concatenate((got[bounds[i] : bounds[i + 1]], ended))
                ids.append(_FIRST if key is None else key)
                nulls += key is None
                counts.append(len(own))
                frames.append(z.compress(own.tobytes()))
                held += len(frames[-1])
                if held >= SHARD_BYTES:
                    yield shard()
                    start += sum(counts)
                    seq, ids, counts, frames, held, nulls = seq + 1, [], [], [], 0, 0
        if ids:
            yield shard()

    ranged = base.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(trimmed(run), SHARDS).write.option("compression", "none").parquet(f"{out}/shards")


#: Stands for null ids, which come first; a shard says how many it has.
_FIRST = -(1 << 63)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    small_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(f"{out}/shards")
    dictionary = spark.read.parquet(f"{out}/dictionary").first().dictionary
    shared = spark.sparkContext.broadcast(bytes(dictionary))
    # one number for each part, of which there are as many as partitions
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = np.concatenate(([0], np.cumsum([r.n for r in totals], dtype=np.int64)))
    base = {r.part: int(b) for r, b in zip(totals, before)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, nulls, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s = Shard(raw, shared.value)
                own = [s.ids(i) for i in range(len(s.docs))]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                c = s.counts.astype(np.int64)
                cols = [pa.array(s.docs, mask=np.arange(len(s.docs)) < nulls), pa.array(base[part] + start + np.cumsum(c) - c), pa.array(c), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("part", "start", "n_null", "shard").mapInArrow(trimmed(run), kind)


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[int] | None:
    """One document's ids: only shards whose range holds the id are read, only its frame decompressed."""
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first().dictionary)
    near = spark.read.schema(SHARDS).parquet(f"{out}/shards").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for r in near.select("n_null", "shard").toLocalIterator():
        s = Shard(bytes(r.shard), dictionary)
        i = r.n_null + np.searchsorted(s.docs[r.n_null :], doc_id)
        if i < len(s.docs) and s.docs[i] == doc_id:
            return s.ids(i).tolist()
    return None


def new_store(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
