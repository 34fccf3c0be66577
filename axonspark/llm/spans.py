"""Substring dedup over sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import words, worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import Scratch

#: A run is the shortest one from, or up to, each sentence that has so many words.
LEAST_WORDS = 20
#: Texts that are handled together, in bytes.
CHUNK_BYTES = 8 << 20
#: Runs of one block at the receiver.
BLOCK_RUNS = 1 << 21
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[list(b"\"')]}")] = True
_ODD, _ODD2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _run_hashes(value: np.ndarray, a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    """64-bit hash of each run [a, b) of the words with hashes ``value``.

    Windows of 1, 2, 4, ... words are hashed from the two halves of each and
    finalised; a run is the two largest windows that begin and end with it.
    """
    size = b - a
    out = np.zeros(len(a), np.uint64)
    if not len(a):
        return out
    level = np.frexp(size.astype(np.float64))[1] - 1  # floor(log2(size)), as sizes are under 2**53
    now, times = words.mix(value ^ np.uint64(odd)), np.uint64(odd | 1)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << k - 1
            now = words.mix(now[:-half] * times + now[half:])
        here = np.flatnonzero(level == k)
        out[here] = words.mix(words.mix(now[a[here]] + size[here].astype(np.uint64)) * times + now[b[here] - (1 << k)])
    return out


class Sentences:
    """Of a slice of texts: words, sentences and runs, all as arrays.

    A sentence ends after a word that ends in . ! ? (closing quotes and brackets
    aside) or in an ellipsis, at a line break, and at the end of the text.
    """

    def __init__(self, column: pa.Array, least: int):
        self.body, self.ends = words.raw(column)
        start, end, first = words.spans(self.body, self.ends)
        n = len(start)
        self.rows = len(column)
        row = np.repeat(np.arange(self.rows), np.diff(first))
        last = np.zeros(n, dtype=bool)
        if n:
            at = end - 1
            for _ in range(3):
                at = np.where(_CLOSE[self.body[at]] & (at > start), at - 1, at)
            last = _STOP[self.body[at]]
            wide = np.maximum(at - 2, 0)
            last |= (self.body[wide] == 0xE2) & (self.body[np.maximum(at - 1, 0)] == 0x80) & (self.body[at] == 0xA6) & (wide >= start)
            breaks = np.concatenate([[0], np.cumsum((self.body == 10) | (self.body == 13))])
            last[:-1] |= breaks[start[1:]] > breaks[end[:-1]]
            last[:-1] |= row[1:] != row[:-1]
            last[-1] = True
        stop = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        self.row = row[begin] if len(stop) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.start = start[begin] if len(stop) else begin
        m = len(stop)
        # the runs, by sentence: [run_low, run_high)
        index = np.arange(m)
        high = np.searchsorted(stop, begin + least, "left") + 1
        low = np.searchsorted(begin, stop - least, "right") - 1
        forward = (high <= m) & (self.row[np.minimum(high, m) - 1] == self.row) if m else np.zeros(0, bool)
        backward = (low >= 0) & (self.row[np.maximum(low, 0)] == self.row) if m else np.zeros(0, bool)
        run = np.concatenate([np.stack([index[forward], high[forward]], 1), np.stack([low[backward], index[backward] + 1], 1)]).reshape(-1, 2)
        run = np.unique(run, axis=0) if len(run) else run.astype(np.int64)
        self.low, self.high = run[:, 0], run[:, 1]
        a = begin[self.low] if m else np.zeros(0, np.int64)
        b = stop[self.high - 1] if m else np.zeros(0, np.int64)
        # two independent hashes: together 128 bits stand for the words of a run
        self.hash = _run_hashes(words.hashes(self.body, start, end), a, b, _ODD)
        self.check = _run_hashes(words.hashes(self.body, start, end, second=True), a, b, _ODD2)

    def keep(self, gone: np.ndarray) -> pa.Array:
        """The texts without the sentences ``gone``."""
        mark = np.zeros(len(self.body) + 1, np.int32)
        if len(self.start):
            until = np.concatenate([self.start[1:], [len(self.body)]])
            until = np.minimum(until, self.ends[self.row + 1])
            np.add.at(mark, self.start[gone], 1)
            np.add.at(mark, until[gone], -1)
        left = np.cumsum(mark[:-1]) == 0
        size = np.concatenate([[0], np.cumsum(left)])[self.ends]
        return pa.LargeStringArray.from_buffers(self.rows, pa.py_buffer(size.astype(np.int64).tobytes()), pa.py_buffer(self.body[left].tobytes())).cast(pa.string())


def pack(keys: np.ndarray, checks: np.ndarray, first: np.ndarray) -> bytes:
    """Ascending 64-bit keys, their second hashes and 64-bit numbers as compressed byte planes."""
    planes = (np.diff(keys, prepend=np.uint64(0)).astype("<u8"), checks.astype("<u8"), first.astype("<i8"))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in planes))


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(24, -1)
    gap, checks, first = (np.ascontiguousarray(body[k : k + 8].T).view(t).ravel() for k, t in ((0, "<u8"), (8, "<u8"), (16, "<i8")))
    return np.cumsum(gap, dtype=np.uint64), checks, first


def _same(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Of sorted runs: whether each is the same as the one before it."""
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
    return same


def _find(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted runs ``keys``, ``checks``, which of ``key``, ``check`` are there)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    while True:  # further only where different runs share the first hash
        on = np.flatnonzero((keys[place] == key) & (checks[place] < check) & (place < len(keys) - 1))
        if not len(on):
            break
        place[on] += 1
    found = np.flatnonzero((keys[place] == key) & (checks[place] == check))
    return place[found], found


def _spread(least: int, blocks: int):
    """Chunks of rows (block -1), and of each chunk every run's hashes with its first document, twice if the chunk repeats it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("spans")
        part, turn, held = TaskContext.get().partitionId(), 0, 0
        kept: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 24 | turn
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in kept:
                    w.write_batch(b)
            rows = [(chunk, -1, out.getvalue().to_pybytes())]
            h, check, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((doc, check, h, block))
            block, h, check, doc = block[order], h[order], check[order], doc[order]
            again = _same(h, check)
            some = ~again
            some[1:] |= ~again[:-1]
            block, h, check, doc = block[some], h[some], check[some], doc[some]
            at = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else []
            for i, j in zip(at, [*at[1:], len(block)] if len(block) else [], strict=True):
                rows.append((chunk, int(block[i]), pack(h[i:j], check[i:j], doc[i:j])))
            for k in range(0, len(rows), 256):
                a, b, c = zip(*rows[k : k + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["chunk", "block", "payload"])
            kept.clear()
            found.clear()

        for b in batches:
            text = b.num_columns - 1
            for at, col in words.slices(b.column(text)):
                s = Sentences(col, least)
                piece = b.slice(at, len(col))
                ids = pa.compute.fill_null(piece.column(text - 1), 2**63 - 1).to_numpy(zero_copy_only=False)
                kept.append(piece)
                found.append((s.hash, s.check, ids[s.row[s.low]] if len(s.low) else np.zeros(0, np.int64)))
                held += len(s.body)
                if held >= CHUNK_BYTES:
                    yield from flush()
                    turn, held = turn + 1, 0
        if kept:
            yield from flush()

    return run


def _answer(t: pa.Table) -> pa.Table:
    """Of one block: to each chunk those of its runs that occur again anywhere, with 1 where the first of all is the chunk's own."""
    worker.begin("spans")
    chunk, got = t["chunk"].to_numpy(), [unpack(x) for x in t["payload"].to_pylist()]
    keys, checks, doc = (np.concatenate(x) for x in zip(*got, strict=True))
    of = np.repeat(np.arange(len(got)), [len(k) for k, _, _ in got])
    order = np.lexsort((chunk[of], doc, checks, keys))
    keys, checks, of = keys[order], checks[order], of[order]
    head = ~_same(keys, checks)
    group = np.cumsum(head) - 1
    many = np.bincount(group)[group] > 1 if len(keys) else head
    keys, checks, of, own = keys[many], checks[many], of[many], (chunk[of] == chunk[of[np.flatnonzero(head)]][group])[many]
    by = np.argsort(of, kind="stable")
    keys, checks, of, own = keys[by], checks[by], of[by], own[by]
    rows = []
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(of)] if len(cuts) else [], strict=True):
        at = i + np.flatnonzero(~_same(keys[i:j], checks[i:j]))
        rows.append((int(chunk[of[i]]), int(t["block"][int(of[i])].as_py()), pack(keys[at], checks[at], own[at].astype(np.int64))))
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(a, pa.int64()), "block": pa.array(b, pa.int32()), "payload": pa.array(c, pa.binary())})


def _apply(least: int, names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        worker.begin("spans")
        block, payload = t["block"].to_pylist(), t["payload"].to_pylist()
        known = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        known += [unpack(x) for b, x in zip(block, payload, strict=True) if b >= 0]
        keys, checks, own = (np.concatenate(x) for x in zip(*known, strict=True))
        order = np.lexsort((checks, keys))
        keys, checks, own = keys[order], checks[order], own[order]
        rows = pa.ipc.open_stream(next(x for b, x in zip(block, payload, strict=True) if b < 0)).read_all().combine_chunks()
        text = rows.num_columns - 1
        pieces = [(at, Sentences(col, least)) for at, col in words.slices(rows[names[-1]])]
        ids = pa.compute.fill_null(rows.column(text - 1), 2**63 - 1).to_numpy()
        key, hit, where = [], [], []
        for p, (at, s) in enumerate(pieces):
            place, found = _find(keys, checks, s.hash, s.check)
            key.append(place)
            hit.append(np.stack([np.full(len(found), p), found], 1).reshape(-1, 2))
            where.append(np.stack([ids[at + s.row[s.low[found]]], at + s.row[s.low[found]], s.low[found]], 1).reshape(-1, 3))
        key, hit, where = np.concatenate(key), np.concatenate(hit), np.concatenate(where)
        order = np.lexsort((where[:, 2], hit[:, 0], where[:, 1], where[:, 0], key))
        first = np.zeros(len(key), bool)
        first[order] = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else False
        drop = ~(first & (own[key] == 1)) if len(key) else first
        text_out, n, gone_n = [], [], []
        for p, (_, s) in enumerate(pieces):
            mine = hit[drop & (hit[:, 0] == p), 1]
            mark = np.zeros(len(s.start) + 1, np.int64)
            np.add.at(mark, s.low[mine], 1)
            np.add.at(mark, s.high[mine], -1)
            gone = np.cumsum(mark[:-1]) > 0
            text_out.append(s.keep(gone))
            n.append(np.diff(s.first))
            gone_n.append(np.bincount(s.row[gone], minlength=s.rows))
        cols = [c for k, c in enumerate(rows.columns) if k < text - 1]
        made = [pa.chunked_array(text_out, pa.string()), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(gone_n).astype(np.int64))]
        return pa.Table.from_arrays([*cols, *made], names=[*names[:-2], names[-1], "n_sentences", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with its texts cleaned, and n_sentences and n_removed.

    From each sentence on, and up to each sentence, the shortest run of
    sentences with ``least`` words is hashed (words with A-Z folded, white space
    aside; by two 64-bit hashes, compared whole). A run that occurs more than
    once has its first occurrence, by id, then by position; every sentence that
    any other occurrence covers is removed with the white space after it. So a repeated passage of twice ``least``
    words is covered whole, whatever stands around it; texts of fewer words have
    no runs.

    Null texts count as empty and come back empty; null ids order last; rows
    with the same id are ordered as they lie; columns named n_sentences or
    n_removed are replaced; an empty table gives an empty result.

    A chunk's runs move as one compressed row a block, each run at most twice
    however often the chunk repeats it, so that a line that all documents share
    costs two numbers a chunk. The chunks then get back only what repeats, four of
    them, about 32 MB of text, to a task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")
    keep = [c for c in docs.columns if c not in (text, "n_sentences", "n_removed")]
    order, body = unused(docs.columns, "order"), unused(docs.columns, "clean_text")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id}`").cast("long").alias(order), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    volume = src.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = max(1, -(-volume // (24 * BLOCK_RUNS)))
    spread = scratch.keep(src.mapInArrow(_spread(least, blocks), "chunk long, block int, payload binary"), "spread")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = spread.where("block >= 0").repartition(max(parts, min(blocks, 8 * parts)), "block").groupBy("block").applyInArrow(_answer, "chunk long, block int, payload binary")
    both = spread.where("block < 0").unionByName(answers)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(body, T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    chunks = spread.where("block < 0").count()
    out = both.repartition(max(parts, -(-chunks // 4)), "chunk").groupBy("chunk").applyInArrow(_apply(least, src.columns), schema)
    return out.select(*[F.col(body).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c in keep or c == text], "n_sentences", "n_removed")
