"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

Texts are normalised to words of letters and digits with A-Z in lower case. The
windows of the benchmark (``size`` consecutive words of an item, or a shorter
item as a whole) make one automaton whose letters are words: a document's words
are looked up in the benchmark's vocabulary, exactly and by arrays, and its text
is scanned once. Matches are ranges of words, which map back to the code points
of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import words, worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import Scratch, whole_texts

#: An automaton holds so many windows; a larger benchmark is scanned for in as many blocks as it needs.
WINDOWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def windows(items: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Distinct (window, item) of a benchmark: the window's words joined by spaces, the item's id as a string."""
    found = items.select(F.col(f"`{id}`").cast("string").alias("item"), F.regexp_extract_all(F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return found.select("item", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k, size), " "))).alias("window")).distinct()


class Automaton:
    """The windows of a block, their items, and the automaton that finds them; it is built once in each worker."""

    def __init__(self, pairs: list):
        of: dict[str, set] = {}
        for window, item in pairs:
            of.setdefault(window, set()).add(item)
        self.windows = sorted(of)
        self.items = [sorted(of[w] - {None}) for w in self.windows]
        self.built = None

    def __getstate__(self) -> dict:
        return {"windows": self.windows, "items": self.items, "built": None}

    def build(self) -> None:
        vocabulary = sorted({w for x in self.windows for w in x.split(" ")})
        self.vocabulary = pa.array([w.encode() for w in vocabulary], pa.large_binary())
        # one code point a word, from 1 on and around the surrogates; 0 is any other word
        point = {w: chr(k + 1 if k + 1 < 0xD800 else k + 1 + 0x800) for k, w in enumerate(vocabulary)}
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = np.zeros(len(self.windows), np.int64)
        for k, x in enumerate(self.windows):
            letters = [point[w] for w in x.split(" ")]
            self.length[k] = len(letters)
            machine.add_word("".join(letters), k)
        if len(machine):
            machine.make_automaton()
        self.built = machine

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Of a slice of texts: the words of each, and (row, first word, word after the last, window) of its matches."""
        if self.built is None:
            self.build()
        body, ends = words.raw(column)
        start, end, first = words.spans(body, ends, words.MARKS)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.built) and len(start):
            k = pa.compute.fill_null(pa.compute.index_in(words.values(body, start, end), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(1)
            k[k >= 0xD800] += np.uint32(0x800)
            known = np.concatenate([[0], np.cumsum(k > 0)])[first]
            for row in np.flatnonzero(np.diff(known)).tolist():
                a, b = first[row], first[row + 1]
                hits = list(self.built.iter(k[a:b].astype("<u4").tobytes().decode("utf-32-le")))
                if hits:
                    last, which = np.array(hits, np.int64).T
                    found.append((row, last + 1 - self.length[which], last + 1, which))
        return np.diff(first), found

    def where(self, column: pa.Array, row: int, hit: np.ndarray) -> list[dict]:
        """The code points, end exclusive, of each stretch of hit words."""
        body, ends = words.raw(column.slice(row, 1))
        start, end, _ = words.spans(body, ends, words.MARKS)
        point = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        return [{"start": x, "end": y} for x, y in zip(point[start[a]].tolist(), point[end[b]].tolist(), strict=True)]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, carry: list[str] | None = None, block: int = WINDOWS) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, or all) with n_words, n_hit, items and spans.

    n_words counts the document's words, n_hit those inside any occurrence of a
    window; items are the ids, as strings in order, of the items with a window
    that occurs; spans are the stretches of hit words as code points of the
    original text, end exclusive, so that they can be cut out or looked at.

    A null or empty text has no words, an item without words no windows. Rows of
    one item id are one item; the windows of an item without an id hit words
    but aren't listed. Repeated documents each keep their row. An empty
    benchmark hits nothing, and empty documents give an empty table. Columns of
    ``docs`` called like a result are replaced.

    Documents aren't shuffled. Windows are counted first: up to ``block`` of
    them are one automaton, sent to all tasks; a larger benchmark is dealt into
    blocks by hash, and the documents, with what was found so far, are written
    between the scans.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    scratch = Scratch(spark, "leaks")
    pairs = scratch.keep(windows(items, item_id, item_text, size), "windows")
    blocks = max(1, -(-pairs.count() // block))
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    keep = [c for c in carry or docs.columns if c.lower() not in {f.name for f in made}]
    body, marks, names = (unused(docs.columns, n) for n in ("body", "marks", "found"))
    state = [T.StructField(body, T.StringType()), T.StructField(marks, T.BinaryType()), T.StructField(names, T.ArrayType(T.StringType()))]
    own = [docs.schema[c] for c in keep]
    now = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body), F.lit(None).cast("binary").alias(marks), F.lit(None).cast("array<string>").alias(names))
    for k in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).select("window", "item").collect()
        shared = spark.sparkContext.broadcast(Automaton([tuple(r) for r in rows]))
        last = k == blocks - 1
        scanned = now.mapInArrow(_scan(shared, len(keep), last, [*keep, *[f.name for f in (made if last else state)]]), T.StructType([*own, *(made if last else state)]))
        now = scanned if last else scratch.keep(scanned, "scanned")
    return now


def _scan(shared, kept: int, last: bool, names: list[str]):
    """One scan of all texts for a block's windows; the last one gives the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("leaks")
        block: Automaton = shared.value
        for b in batches:
            before, listed = b.column(kept + 1), b.column(kept + 2)
            sizes, hits, ids, places, marks = [np.zeros(0, np.int64)], [], [], [], []
            for at, col in words.slices(b.column(kept)):
                n, found = block.scan(col)
                sizes.append(n)
                here = {row: (a, z, which) for row, a, z, which in found}
                for row in range(len(col)):
                    seen = before[at + row].as_py()
                    if row not in here and not seen:
                        hits.append(0), ids.append([]), places.append([]), marks.append(None)
                        continue
                    change = np.zeros(n[row] + 1, np.int64)
                    own: set[str] = set(listed[at + row].as_py() or ())
                    if row in here:
                        a, z, which = here[row]
                        np.add.at(change, a, 1)
                        np.add.at(change, z, -1)
                        for w in np.unique(which).tolist():
                            own.update(block.items[w])
                    hit = np.cumsum(change[:-1]) > 0
                    if seen:
                        hit |= np.unpackbits(np.frombuffer(seen, np.uint8), count=len(hit)).astype(bool)
                    hits.append(int(hit.sum()))
                    ids.append(sorted(own))
                    places.append(block.where(col, row, hit) if last else [])
                    marks.append(None if last else np.packbits(hit).tobytes())
            found_ids = pa.array(ids, pa.list_(pa.string()))
            if last:
                spans = pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                columns = [*b.columns[:kept], pa.array(np.concatenate(sizes)), pa.array(hits, pa.int64()), found_ids, spans]
            else:
                columns = [*b.columns[: kept + 1], pa.array(marks, pa.binary()), found_ids]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
