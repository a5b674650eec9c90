"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a Viterbi pass.

The pieces and scores of a model file become byte strings in one automaton: a table of
transitions over bytes, and for each state its longest piece and a link to the state of the next
shorter one. Reading a byte moves the state once; then, following the output links, each piece
that ends here offers best[start] + score, and the best stays. A byte that no piece covers falls
back to its byte piece at UNKNOWN below the least score. Ties go to the longer last piece.

A piece holds the space mark only at its front (or is all marks), so a text falls into segments,
a run of spaces with the other characters after it, that are segmented alone. The distinct
segments of a batch run through the automaton in lockstep, one byte of all of them at a time.

Text is encoded as it is (no normalisation), with a space before it, as the model's family
does; decoding gives back the exact bytes.

Defined results: null or empty text has no pieces and decodes to the empty text; every row gives
a row; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Words, chunks, ragged, small_batches, strings, trimmed

MARK = "▁"
UNKNOWN = 10.0
#: Longer segments (runs of bytes without a space) are worked on one at a time, in memory that follows their length.
TOGETHER = 64
#: Bytes of texts whose segments are found and made distinct together.
CHUNK = 2 << 20
_LIVE: dict[str, "Automaton"] = {}
_MARK = np.frombuffer(MARK.encode(), np.uint8)
#: Bytes that no text has stand for those of a mark in the text itself, which goes by byte pieces, so that it is not read back as a space.
_LITERAL = np.array([0xF8, 0xF9, 0xFA], np.uint8)


class Automaton:
    """Transitions, and per state: length, score and number of its longest piece, and the state of the next shorter one."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: np.ndarray):
        next_, depth = [dict()], [0]
        piece = {0: -1}
        order = []
        self.scores = np.array([s for _, s, _ in pieces] or [0.0])
        for k, (text, _, _) in enumerate(pieces):
            at = 0
            for c in text:
                to = next_[at].get(c)
                if to is None:
                    to = len(next_)
                    next_[at][c] = to
                    next_.append({})
                    depth.append(depth[at] + 1)
                at = to
            piece[at] = k
        n = len(next_)
        go = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        own = np.full(n, -1, np.int32)
        for s, k in piece.items():
            own[s] = k
        link = np.zeros(n, np.int32)  # the nearest state on the way of failures at which a piece ends; 0: none
        order = [0]
        for s in order:  # breadth first: a state's failure is shallower and ready
            f = fail[s]
            if s:
                go[s] = go[f]
            for c, to in next_[s].items():
                fail[to] = go[f, c] if s else 0
                go[s, c] = to
                order.append(to)
            if s:
                link[s] = f if own[f] >= 0 else link[f]
        self.go = go.reshape(-1)
        self.first = np.where(own >= 0, np.arange(n), link).astype(np.int32)  # where to begin
        self.link = link
        length = np.array([len(t) for t, _, _ in pieces] or [0], np.int32)
        self.length = np.where(own >= 0, length[own], 0).astype(np.int32)
        self.score = np.where(own >= 0, self.scores[own], 0.0)
        self.id = np.where(own >= 0, np.array([i for _, _, i in pieces] or [0], np.int32)[own], -1).astype(np.int32)
        self.byte_ids = byte_ids
        self.fallback = float(self.scores.min()) - UNKNOWN
        top = max([int(i) for _, _, i in pieces] + [int(byte_ids.max())]) + 1
        text = [b""] * top
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        for t, _, i in pieces:
            text[i] = t
        text = [t.replace(MARK.encode(), b" ") for t in text]
        self.text_at = np.concatenate(([0], np.cumsum([len(t) for t in text])))
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def segment(self, cells: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cells[i, :lengths[i]] are the bytes of segment i, longest first. Gives all ids, each segment's count, and its score."""
        n, width = cells.shape
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)  # length of the last piece
        which = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, width + 1), "right")
        for p in range(1, width + 1):
            m = live[p - 1]
            byte = cells[:m, p - 1]
            state = self.go[state[:m].astype(np.int64) * 256 + byte]
            now = best[p - 1, :m] + self.fallback
            size = np.ones(m, np.int32)
            ident = self.byte_ids[byte]
            at = self.first[state]
            rows = np.flatnonzero(at)
            at = at[rows]
            while len(rows):
                k = self.length[at]
                offer = best[p - k, rows] + self.score[at]
                won = offer > now[rows]  # longest first: of equals the longer piece stays
                r = rows[won]
                now[r], size[r], ident[r] = offer[won], k[won], self.id[at[won]]
                at = self.link[at]
                on = at > 0
                rows, at = rows[on], at[on]
            best[p, :m], back[p, :m], which[p, :m] = now, size, ident
        # walk back together; pieces come out last first
        at = lengths.astype(np.int64).copy()
        rows = np.flatnonzero(at)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(n, np.int64)
        while len(rows):
            steps.append((rows, which[at[rows], rows]))
            counts[rows] += 1
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for k, (r, ids) in enumerate(steps):
            out[ends[r] - 1 - k] = ids
        return out, counts, best[lengths, np.arange(n)]


    def segment_one(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """segment() of one long segment: stepping through plain memory costs a fraction of array calls for each byte."""
        go, first, link, length, score, ident = (memoryview(x) for x in (self.go, self.first, self.link, self.length, self.score, self.id))
        own, fallback = self.byte_ids.tolist(), self.fallback
        best, back, which = array("d", [0.0]) * (len(text) + 1), array("i", [0]) * (len(text) + 1), array("i", [0]) * (len(text) + 1)
        state, before = 0, 0.0
        for p, byte in enumerate(text, 1):
            state = go[state * 256 + byte]
            now, size, i = before + fallback, 1, own[byte]
            at = first[state]
            while at:
                k = length[at]
                offer = best[p - k] + score[at]
                if offer > now:  # longest first: of equals the longer piece stays
                    now, size, i = offer, k, ident[at]
                at = link[at]
            best[p] = before = now
            back[p], which[p] = size, i
        out, at = array("i"), len(text)
        while at:
            out.append(which[at])
            at -= back[at]
        return np.array(out, np.int32)[::-1].copy(), np.array([len(out)]), np.array([before])


def automaton(path: str) -> Automaton:
    """Of a model file, once per process."""
    if path not in _LIVE:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, byte_ids = [], np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in text[1:] and text.strip(MARK):
                    raise ValueError(f"a piece with a space inside: {text}")
                pieces.append((text.encode(), sp.get_score(i), i))
        _LIVE[path] = Automaton(pieces, byte_ids)
        _LIVE[path].byte_ids[_LITERAL] = byte_ids[_MARK]
    return _LIVE[path]


def segments_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Every document with a space before it, cut before each run of spaces; and the new bytes and offsets."""
    n_docs = len(offsets) - 1
    full = np.diff(offsets) > 0
    at = offsets + np.concatenate(([0], np.cumsum(full)))
    body = np.empty(int(at[-1]), np.uint8)
    put = np.ones(len(body), bool)
    put[at[:-1][full]] = False
    body[put] = data
    mark = np.flatnonzero((body[:-2] == _MARK[0]) & (body[1:-1] == _MARK[1]) & (body[2:] == _MARK[2]))
    for k in range(3):
        body[mark + k] = _LITERAL[k]
    body[~put] = 0x20
    space = body == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[at[:-1][full]] = True
    starts = np.flatnonzero(head)
    assert n_docs == len(at) - 1
    return Words(body, starts, np.append(starts[1:], len(body))[: len(starts)], np.searchsorted(starts, at)), body, at


def encode_chunk(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a chunk's documents, the bounds of each one's, and each one's score."""
    seg, body, _ = segments_of(data, offsets)
    _, first, which = np.unique(seg.hashes(), return_index=True, return_inverse=True)
    s, e = seg.starts[first], seg.ends[first]
    spaces = body == 0x20
    run = np.concatenate(([0], np.cumsum(spaces)))
    length = (e - s) + 2 * (run[e] - run[s])  # a space is the mark's three bytes
    order = np.argsort(-length, kind="stable")
    counts, scores, at = np.zeros(len(first), np.int64), np.zeros(len(first)), np.zeros(len(first), np.int64)
    pool, total = [], 0
    lo = 0
    while lo < len(order):
        # segments of similar length together, in a table of bounded size
        widest = int(length[order[lo]])
        hi = lo + 1 if widest > 64 * TOGETHER else min(len(order), lo + max(1, (1 << 20) // widest))
        if widest > TOGETHER:
            hi = min(hi, lo + int(np.searchsorted(-length[order[lo:hi]], -(widest // 2), "right")))
        rows = order[lo : max(hi, lo + 1)]
        size = length[rows]
        span = e[rows] - s[rows]
        raw = body[ragged(s[rows], span)]
        times = np.where(raw == 0x20, 3, 1)
        flat = np.repeat(raw, times)
        inner = ragged(np.zeros(len(raw), np.int64), times)
        flat = np.where(np.repeat(raw == 0x20, times), _MARK[inner], flat)
        if widest > 64 * TOGETHER:  # alone
            ids, c, best = auto.segment_one(flat.astype(np.uint8).tobytes())
        else:
            cells = np.zeros((len(rows), widest), np.uint8)
            cells[np.arange(widest) < size[:, None]] = flat
            ids, c, best = auto.segment(cells, size)
        counts[rows], scores[rows] = c, best
        at[rows] = total + np.concatenate(([0], np.cumsum(c)[:-1]))
        total += len(ids)
        pool.append(ids)
        lo += len(rows)
    ids = np.concatenate(pool) if pool else np.empty(0, np.int32)
    c = counts[which]
    out = ids[ragged(at[which], c)]
    bounds = np.concatenate(([0], np.cumsum(c)))[seg.first]
    run = np.concatenate(([0.0], np.cumsum(scores[which])))
    return out, bounds, run[seg.first[1:]] - run[seg.first[:-1]]


def decode_chunk(auto: Automaton, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the documents and their offsets: pieces put together, without the space before each."""
    size = auto.text_at[ids + 1] - auto.text_at[ids]
    body = auto.text[ragged(auto.text_at[ids], size)]
    at = np.concatenate(([0], np.cumsum(size)))[bounds]
    full = np.diff(bounds) > 0
    keep = np.ones(len(body), bool)
    keep[at[:-1][full]] = False
    return body[keep], at - np.concatenate(([0], np.cumsum(full)))


def _apart(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts that differ from the one before, and for each row, in order, which of them it has."""
    column = pc.fill_null(column, "")
    fresh = np.ones(len(column), bool)
    if len(column) > 1:
        fresh[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return column.filter(pa.array(fresh)), np.cumsum(fresh) - 1


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, score (sum of the pieces' scores), exact (whether decoding gives back the text)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model_path)
        for batch in batches:
            texts, which = _apart(batch.column(1))  # copies stand together where a mixture has made them
            data, offsets = strings(texts)
            for lo, hi, body, offs in chunks(data, offsets, CHUNK):
                ids, bounds, score = encode_chunk(auto, body, offs)
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                exact = pa.array(_same(auto, ids, bounds, body, offs))
                a, z = np.searchsorted(which, (lo, hi))
                at = pa.array(which[a:z] - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *(c.take(at) for c in (column, pa.array(score), exact))], ["doc_id", "ids", "score", "exact"])

    return base.mapInArrow(trimmed(run), "doc_id long, ids array<int>, score double, exact boolean")


def _same(auto: Automaton, ids: np.ndarray, bounds: np.ndarray, body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    again, at = decode_chunk(auto, ids, bounds)
    return np.array([np.array_equal(again[a:b], body[c:d]) for a, b, c, d in zip(at, at[1:], offs, offs[1:])], bool)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model_path)
        for batch in batches:
            column = batch.column(1)
            lists = column.to_pylist() if column.null_count else None
            if lists is None:
                offs = column.offsets.to_numpy().astype(np.int64)
                ids = column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
                bounds = offs - offs[0]
            else:
                rows = [np.array(x or [], np.int64) for x in lists]
                ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
            body, at = decode_chunk(auto, ids.astype(np.int64), bounds)
            text = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), score, and whether decoding gives back the text exactly."""
    import zlib

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model_path)
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi, body, offs in chunks(data, offsets, CHUNK):
                ids, bounds, score = encode_chunk(auto, body, offs)
                raw = ids.astype("<u4").tobytes()
                same = _same(auto, ids, bounds, body, offs)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array(score), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_crc32", "score", "exact"])

    return base.mapInArrow(trimmed(run), "doc_id long, n_pieces long, ids_crc32 long, score double, exact boolean")
