"""Exact n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix is never joined with itself as it stands. Its columns
(n-grams) are counted block by block; each document then orders its n-grams
from rare to frequent, and only the head of that order, as long as the size
bound asks for, is listed by n-gram. A pair whose sizes, whose positions in the
head, or whose numbers of n-grams that any other document has, bound the overlap
below what the threshold needs is discarded. For the rest blocks of whole rows
are multiplied: in a block a row's overlaps with all others are accumulated over
its columns and tested exactly.

Skew: columns are counted inside each chunk of documents before anything is
shuffled, so that an n-gram that all documents share moves as one number a
chunk; exact copies are one row of the matrix; and inside one column's list the
product starts with two pivots against all others. What a pivot links is one
component and needs no further product, so a list of M near copies costs about M
rows and not M * M pairs. What stays open is multiplied by families, in blocks
of bounded size, and only pairs across families are ever written as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.llm import words, worker
from axonspark.llm.graph import components
from axonspark.llm.scratch import Scratch

#: N-grams of documents that are counted together before they move, and of a column block at the receiver.
CHUNK_GRAMS = 1 << 20
BLOCK_GRAMS = 1 << 21
#: Bytes of text behind an n-gram, for the number of column blocks alone.
GRAM_BYTES = 6
#: N-grams of a block of the product, on either side.
CELL_GRAMS = 1 << 18
#: A list with so many early entries or fewer is completed in the first turn after blocks by label.
FEW = 256


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit keys and their counts, as compressed byte planes of the gaps."""
    gap = np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    top = np.minimum(counts, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gap).tobytes() + np.ascontiguousarray(top).tobytes())


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(8, -1)
    gap = np.ascontiguousarray(body[:4].T).view("<u4").ravel()
    return np.cumsum(gap, dtype=np.uint32), np.ascontiguousarray(body[4:].T).view("<u4").ravel()


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def column(h: np.ndarray, blocks: int) -> np.ndarray:
    """Column block (upper half) and 32-bit column in it (lower half), ascending with the hash: floor(h * blocks / 2**32)."""
    n = np.uint64(blocks)
    return (h >> np.uint64(32)) * n + ((h & np.uint64(0xFFFFFFFF)) * n >> np.uint64(32))


def prefix(n: int, num: int, den: int) -> int:
    """N-grams at the head of a document's order of which any partner's head shares one."""
    return n - -(-num * n // den) + 1


def _chunks(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """A row per document (its set's size and digest; an empty set has none), and of each chunk its texts (block -1) and column counts by column block.

    A chunk has each of its different sets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("jaccard")
        part, turn = TaskContext.get().partitionId(), 0
        grams: list[np.ndarray] = []
        texts: list[pa.Array] = []
        seen: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 24 | turn
            body = pa.BufferOutputStream()
            t = pa.table({"text": pa.chunked_array(texts, pa.large_string())})
            with pa.ipc.new_stream(body, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            rows = [(chunk, -1, body.getvalue().to_pybytes())]
            x = column(np.concatenate(grams), blocks)
            x.sort()
            at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            c, x = np.diff(np.append(at, len(x))), x[at]
            block, low = x >> np.uint64(32), x.astype(np.uint32)
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for i, j in zip(at, [*at[1:], len(block)], strict=True):
                rows.append((chunk, int(block[i]), pack(low[i:j], c[i:j])))
                if len(rows) >= 256:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
            grams.clear()
            texts.clear()
            seen.clear()

        def batch(rows):
            a, b, c = zip(*rows, strict=True)
            none = [pa.nulls(len(rows), t) for t in (kind, pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=names)

        held, kind = 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for at, col in words.slices(b.column(1)):
                values, first = words.shingle_sets(col, size)
                dig, fresh = [], []
                for k, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    d = digest(values[i:j]) if j > i else None
                    dig.append(d)
                    if d is not None and d not in seen:
                        seen.add(d)
                        fresh.append(k)
                        grams.append(values[i:j])
                        held += j - i
                m = len(col)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, m), pa.array(np.diff(first), pa.int64()), pa.array(dig, pa.binary()), pa.array(np.full(m, part << 24 | turn), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
                if fresh:
                    texts.append(col.take(pa.array(fresh)))
                if held >= CHUNK_GRAMS:
                    yield from flush()
                    turn, held = turn + 1, 0
        if held:
            yield from flush()

    names = ["id", "n_shingles", "digest", "chunk", "block", "payload"]
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, digest binary, chunk long, block int, payload binary")


def _answer(t: pa.Table) -> pa.Table:
    """Of one column block: to each chunk, those of its columns that hold more than one document, with the count."""
    worker.begin("jaccard")
    got = [unpack(x) for x in t["payload"].to_pylist()]
    keys = np.concatenate([k for k, _ in got])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in got])[order].astype(np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total, keys = np.add.reduceat(counts, at), keys[at]
    keys, total = keys[total > 1], total[total > 1]
    rows = []
    for chunk, block, (k, _) in zip(t["chunk"].to_pylist(), t["block"].to_pylist(), got, strict=True):
        if len(keys):
            where = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[where] == k
            if hit.any():
                rows.append((chunk, block, pack(k[hit], total[where[hit]])))
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(a, pa.int64()), "block": pa.array(b, pa.int32()), "payload": pa.array(c, pa.binary())})


def _heads(size: int, num: int, den: int, blocks: int):
    """Of one chunk: a row for each n-gram in the head of a document that another has too, and the text of each document that has one.

    ``s`` is the number of a document's n-grams that another has too. A set that
    lies in several chunks (``m`` of them, block -2) is left to the first; its
    n-grams count ``m`` times without being another's.
    """

    def run(t: pa.Table) -> pa.Table:
        worker.begin("jaccard")
        block, payload = t["block"].to_pylist(), t["payload"].to_pylist()
        copies = {x: (m, own) for b, x, m, own in zip(block, payload, t["m"].to_pylist(), t["own"].to_pylist(), strict=True) if b == -2}
        known, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for b, x in zip(block, payload, strict=True):
            if b >= 0:
                k, c = unpack(x)
                known.append(np.uint64(b) << np.uint64(32) | k.astype(np.uint64))
                df.append(c)
        known, df = np.concatenate(known), np.concatenate(df)
        order = np.argsort(known)
        known, df = known[order], df[order]
        key, dig, n_of, s_of, pos, texts, text_of = [], [], [], [], [], [], []
        for b, x in zip(block, payload, strict=True):
            if b != -1 or not len(known):
                continue
            for _, col in words.slices(pa.ipc.open_stream(x).read_all()["text"]):
                values, first = words.shingle_sets(col, size)
                full = column(values, blocks)
                at = np.minimum(np.searchsorted(known, full), len(known) - 1)
                count = np.where(known[at] == full, df[at], np.uint32(1))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                shared = np.bincount(row[count > 1], minlength=len(first) - 1)
                for r in np.flatnonzero(shared):
                    i, j = first[r], first[r + 1]
                    v, c = values[i:j], count[i:j]
                    d = digest(v)
                    m, own = copies.get(d, (1, True))
                    n, s = int(j - i), int((c > m).sum())
                    alone, head = n - s, prefix(n, num, den)
                    if alone >= head or not own:
                        continue
                    v, c = v[c > m], c[c > m]
                    v = v[np.lexsort((v, c))][: head - alone]
                    key.append(v.astype(np.int64))
                    dig += [d] * len(v)
                    n_of.append(np.full(len(v), n))
                    s_of.append(np.full(len(v), s))
                    pos.append(np.arange(alone + 1, alone + 1 + len(v)))
                    texts.append(col[r].as_py())
                    text_of.append(d)
        k = len(texts)
        cat = lambda x: pa.concat_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()), pa.nulls(k, pa.int64())])
        return pa.table(
            {"key": cat(key), "digest": pa.array(dig + text_of, pa.binary()), "n": cat(n_of), "s": cat(s_of), "pos": cat(pos), "text": pa.concat_arrays([pa.nulls(len(dig), pa.string()), pa.array(texts, pa.string())])}
        )

    return run


def multiply(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """One block of the product: the rows ``left`` against the rows ``right`` of the incidence [first, first + 1).

    The overlaps of a row with all of the other side are accumulated over its
    columns, then the pairs below the bound go. Of the links that remain, those
    that join rows not yet joined are returned: fewer than there are rows.
    """
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    cols, of = values[right[row]], row[right[row]]
    order = np.argsort(cols, kind="stable")
    cols, of = cols[order], of[order]
    low = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else np.zeros(0, np.int64)
    high, cols = np.append(low[1:], len(of)), cols[low]
    label, out = np.arange(len(n)), []
    for r in np.flatnonzero(left) if len(cols) else ():
        c = values[first[r] : first[r + 1]]
        p = np.minimum(np.searchsorted(cols, c), len(cols) - 1)
        p = p[cols[p] == c]
        size = high[p] - low[p]
        ends = np.cumsum(size)
        at = np.repeat(low[p] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        both = np.bincount(of[at], minlength=len(n))
        linked = np.flatnonzero((den * both >= num * (n[r] + n - both)) & (both > 0) & (label != label[r]))
        if len(linked):
            names, one = np.unique(label[linked], return_index=True)
            out += [(int(r), int(x)) for x in linked[one]]
            label[np.isin(label, names)] = label[r]
    return out


def _product(size: int, num: int, den: int):
    """Links of one block of the product, whose rows are made from its texts: these take less room on their way than hashes."""

    def run(t: pa.Table) -> pa.Table:
        worker.begin("jaccard")
        parts = [words.shingle_sets(col, size) for _, col in words.slices(t["text"])]
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
        side = [t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right")]
        made, d = multiply(np.concatenate([v for v, _ in parts]), first, *side, num, den), t["digest"].to_pylist()
        return pa.table({"a": pa.array([min(d[x], d[y]) for x, y in made], pa.binary()), "b": pa.array([max(d[x], d[y]) for x, y in made], pa.binary())})

    return run


def _index(num: int, den: int):
    """The smaller text of any pair that reaches the threshold has a shared n-gram this early in its order."""
    return (num + den) * (F.col("n") - F.col("pos") + 1) >= 2 * num * F.col("n")


def _most(num: int, den: int):
    """The size of the largest text that may reach the threshold with this one: of both, the n-grams that others have too are at least the overlap."""
    return F.expr(f"{num + den} * s div {num} - n")


def _open(todo: DataFrame, num: int, den: int, scratch: Scratch, label: bool = False) -> DataFrame:
    """The lists that may still join different components, without the entries too poor in shared n-grams for any other.

    Written after the join by list, so that what is aggregated next is added up
    in each task before it moves and no list has to be in one task.
    """
    for _ in range(2):
        lists = todo.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max(_index(num, den)).alias("some"), *([F.min("label").alias("one"), F.max("label").alias("two")] if label else []))
        lists = lists.where("lo <> hi and some" + " and one <> two" * label).select("key", "least")
        todo = scratch.keep(todo.join(lists, "key").where(_most(num, den) >= F.col("least")).drop("least"), "todo")
    return todo


def _pivots(todo: DataFrame, turn: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pivots of each list, the lists with ``last``: whether this turn completes them).

    First come two pivots a list: the text richest in shared n-grams, which in a
    family of near copies is the nearest to all, and one that is the same for
    all lists of a family as far as can be. Lists still open when blocks by
    label are done have all their early entries for pivots if these are few,
    else a share that grows fourfold with each turn.
    """
    early = todo.where(_index(num, den))
    if turn == 0:
        h, all_ = F.xxhash64("digest"), ("digest", "n", "s", "pos", "comp")
        least = [F.min(F.struct(o.alias("o"), h.alias("h"), *all_)) for o in (F.lit(1) - F.col("s") / F.col("n"), F.lit(0.0))]
        both = early.groupBy("key").agg(*[a.alias(f"p{k}") for k, a in enumerate(least)])
        one = [F.struct(*[F.col(f"p{k}.{c}") for c in all_]) for k in range(2)]
        chosen = both.select("key", F.explode(F.array_distinct(F.array(*one))).alias("p")).select("key", "p.*")
        return scratch.keep(chosen, "pivots"), todo.withColumn("last", F.lit(False))
    counts = scratch.keep(early.groupBy("key").agg(F.count("*").alias("i"), F.min("digest").alias("least")), "early")
    step = F.ceil(F.col("i") / F.lit(float(FEW * 4 ** max(0, turn - 2))))
    chosen = early.join(counts, "key").where((F.pmod(F.xxhash64("digest", F.lit(turn)), step) == 0) | (F.col("digest") == F.col("least")))
    chosen = scratch.keep(chosen.drop("i", "least"), "pivots")
    return chosen, todo.join(counts.select("key", (step == 1).alias("last")), "key")


def _of_pivots(todo: DataFrame, chosen: DataFrame, turn: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Blocks of the product (block, digest, left, right) in which pivots meet the entries of their lists that no bound sets apart."""
    x, y = todo.alias("x"), chosen.alias("y")
    size = F.col("x.n") + F.col("y.n")
    bound = 1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    pairs = x.join(y, "key").where((F.col("x.comp") != F.col("y.comp")) & (F.col("x.digest") != F.col("y.digest")))
    pairs = pairs.where((den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")) & ((num + den) * F.least(bound, F.col("x.s"), F.col("y.s")) >= num * size))
    if turn:
        pairs = pairs.where("x.label <> y.label")
    pairs = scratch.keep(pairs.select(F.col("y.digest").alias("pivot"), "x.digest", "x.n").distinct(), "pairs")
    mine = pairs.groupBy("pivot").agg(F.sum("n").alias("grams"))
    slices = scratch.keep(mine.select("pivot", "grams", F.ceil(F.col("grams") / CELL_GRAMS).alias("slices")), "slices")
    blocks = _blocks(slices.agg(F.sum("grams")).first()[0])
    at = lambda s: F.pmod(F.xxhash64("pivot", s), F.lit(blocks)).alias("block")
    right = pairs.join(slices, "pivot").select(at(F.pmod(F.xxhash64("digest"), F.col("slices"))), "digest", F.lit(False).alias("left"), F.lit(True).alias("right"))
    left = slices.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(at(F.col("slice")), F.col("pivot").alias("digest"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    return left.unionByName(right).groupBy("block", "digest").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def _labelled(todo: DataFrame, scratch: Scratch) -> DataFrame:
    """``todo`` with ``label``: the least digest that two steps over the lists reach, the same for nearly all of a family."""
    label = todo.select("digest").distinct().withColumn("label", F.col("digest"))
    for _ in range(2):
        least = todo.join(label, "digest").groupBy("key").agg(F.min("label").alias("label"))
        label = scratch.keep(todo.select("key", "digest").join(least, "key").groupBy("digest").agg(F.min("label").alias("label")), "label")
    return scratch.keep(todo.join(label, "digest"), "todo")


def _of_labels(todo: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of the product in which, of the texts of one label, all outside its largest component meet all of them."""
    texts = scratch.keep(todo.select("label", "digest", "n", "comp").distinct(), "texts")
    sizes = texts.groupBy("label", "comp").agg(F.sum("n").alias("grams"))
    most = sizes.groupBy("label").agg(F.sum("grams").alias("all"), F.max(F.struct("grams", "comp")).alias("most"))
    most = most.where("all > most.grams").select("label", "all", (F.col("all") - F.col("most.grams")).alias("out"), F.col("most.comp").alias("largest"))
    most = scratch.keep(most.select("label", "largest", F.ceil(F.col("out") / CELL_GRAMS).alias("rows"), F.ceil(F.col("all") / CELL_GRAMS).alias("columns"), (F.col("out") + F.col("all")).alias("grams")), "labels")
    blocks = _blocks(most.agg(F.sum("grams")).first()[0])
    texts = texts.join(most, "label")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("digest"), F.col(c))
    left = texts.where("comp <> largest").select("label", "digest", own("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = texts.select("label", "digest", every("rows").alias("i"), own("columns").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    block = F.pmod(F.xxhash64("label", "i", "j"), F.lit(blocks)).alias("block")
    return left.unionByName(right).groupBy(block, "digest").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def _blocks(grams: int | None) -> int:
    return max(1, -(-(grams or 0) // CELL_GRAMS))


def links(docs: DataFrame, scratch: Scratch, size: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (id, text): (sets of each row, for each set that links with another the least of its component).

    Of a group whose members a pivot already joins, the other pairs aren't
    looked at.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // (GRAM_BYTES * BLOCK_GRAMS)))
    counted = scratch.keep(_chunks(docs, size, blocks), "counted")
    sets = scratch.keep(counted.where("block is null").select("id", "n_shingles", "digest"), "sets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    answers = scratch.keep(counted.where("block >= 0").select("chunk", "block", "payload").repartition(max(parts, min(blocks, 8 * parts)), "block").groupBy("block").applyInArrow(_answer, "chunk long, block int, payload binary"), "answers")
    seen = counted.where("block is null and digest is not null").select("chunk", "digest").distinct()
    several = seen.groupBy("digest").agg(F.count("*").alias("m"), F.min("chunk").alias("owner")).where("m > 1")
    several = seen.join(several, "digest").select("chunk", F.lit(-2).alias("block"), F.col("digest").alias("payload"), "m", (F.col("chunk") == F.col("owner")).alias("own"))
    none = [F.lit(None).cast("long").alias("m"), F.lit(None).cast("boolean").alias("own")]
    each = counted.where("block = -1").select("chunk", "block", "payload", *none).unionByName(answers.select("*", *none)).unionByName(several)
    chunks = counted.where("block = -1").count()
    heads = each.repartition(max(parts, -(-chunks // 4)), "chunk").groupBy("chunk").applyInArrow(_heads(size, num, den, blocks), "key long, digest binary, n long, s long, pos long, text string")
    heads = scratch.keep(heads, "heads")
    scratch.drop(counted, answers)
    texts = heads.where("key is null").select("digest", "text")
    todo = heads.where("key is not null").select("key", "digest", "n", "s", "pos", F.col("digest").alias("comp"))
    todo = _open(todo, num, den, scratch)
    found: DataFrame | None = None
    turn = 0
    while not todo.isEmpty():
        mark = scratch.mark()
        if turn == 1:
            todo = _labelled(todo, scratch)
            cells, left = _of_labels(todo, scratch), todo
        else:
            chosen, todo = _pivots(todo, turn, num, den, scratch)
            cells = _of_pivots(todo, chosen, turn, num, den, scratch)
            left = todo.where("not last").drop("last").join(chosen.select("key", "digest"), ["key", "digest"], "left_anti")
        made = cells.join(texts, "digest").repartition(parts, "block").groupBy("block").applyInArrow(_product(size, num, den), "a binary, b binary")
        made = made if found is None else found.unionByName(made)
        label = scratch.keep(components(made, scratch), "roots")
        found = label.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        left = left.drop("comp").join(label, left.digest == label.node, "left").select(*[c for c in left.columns if c != "comp"], F.coalesce("root", "digest").alias("comp"))
        todo = _open(left, num, den, scratch, label=turn > 0)
        scratch.sweep(mark, todo, label)
        turn += 1
    if found is None:
        found = spark.createDataFrame([], "a binary, b binary")
    return sets, found


def ngram_jaccard(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id, the smallest id reachable by links.

    Two texts link when their sets of ``size``-word shingles have den * overlap
    >= num * union. Null or empty texts and texts without words have the empty
    set, link with nothing and are their own component; a shorter text is one
    shingle. Rows with the same id are one node, whatever their texts; a null id
    takes part in nothing: its row has a null component. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    src = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sets, found = links(src.where("id is not null"), scratch, size, num, den)
    full = sets.where("digest is not null")
    several = full.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z")
    again = full.join(several.select("id", "a"), "id").where("digest <> a").select("a", F.col("digest").alias("b"))
    label = scratch.keep(components(found.unionByName(again), scratch), "labels")
    classes = full.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("c"))
    classes = scratch.keep(classes.join(label, classes.digest == label.node, "left").select("digest", "low", "c", "root"), "classes")
    low = classes.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    named = classes.join(low, "root", "left").where("c > 1 or root is not null").select("digest", F.coalesce("least", "low").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop(label, classes)
    out = sets.join(named, "digest", "left").select(F.col("id").alias(id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    none = src.where("id is null")
    nulls = _chunks(none, size, 1).where("block is null").select(F.col("id").alias(id), "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(nulls)
