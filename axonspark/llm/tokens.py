"""Token counts of whole texts (overlap resynchronisation for huge ones)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import words, worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import whole_texts

#: Texts of more code points are encoded in overlapping chunks.
CHUNK = 1 << 15
OVERLAP = 256


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer at ``path``: a tokenizers ``.json`` or a sentencepiece ``.model`` file. Loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if str(path).endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=str(path))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(path))
    t.no_truncation()
    t.no_padding()
    return t


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine's copy of a public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def stable(text: str, at: int) -> bool:
    """True if a byte-level BPE of the GPT-2 kind provably ends a token at ``at``.

    Its pre-tokenizer has no alternative that runs from a non-space character
    into white space, merges never leave a pre-token, and no special string
    holds white space: so between a non-space character and white space every
    encoding of any surrounding text has a boundary. The control characters
    that Python and the library class differently count as neither.
    """
    a, b = text[at - 1], text[at]
    return not a.isspace() and b.isspace() and not "\x1c" <= a <= "\x1f" and not "\x1c" <= b <= "\x1f"


def splice(text: str, encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of ``text``, from encodings of overlapping chunks.

    ``encode`` gives (ids, character offsets). Two neighbouring encodings are
    spliced at the last place inside their overlap that is provably stable and
    at which both have a token boundary; both must also agree on the tokens
    from there to the end of the overlap's last stable place. Where there is no
    such place the overlap doubles, up to the rest of the text, so that the
    result is always that of the whole text.
    """
    n, done, ids = len(text), 0, []
    while done < n:
        end = done + chunk
        if end >= n:
            return ids + encode(text[done:])[0]
        width = overlap
        while True:
            stop = min(end + width, n)
            got, where = encode(text[done:stop])
            if stop == n:
                return ids + got
            ahead, ahead_where = encode(text[end - width if end - width > done else done : stop])
            base = max(end - width, done)
            starts = {s + done: k for k, (s, _) in enumerate(where)}
            ahead_starts = {s + base: k for k, (s, _) in enumerate(ahead_where)}
            common = [p for p in range(stop - 1, max(base, done), -1) if p in starts and p in ahead_starts and stable(text, p)]
            if len(common) >= 2:
                last, cut = common[0], common[-1]
                if got[starts[cut] : starts[last]] == ahead[ahead_starts[cut] : ahead_starts[last]]:
                    ids += got[: starts[last]]
                    done = last
                    break
            width *= 2
    return ids


def encode_all(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of each text as its library gives them, without added special tokens."""
    t = load(path)
    if str(path).endswith(".model"):
        yield from t.encode(texts, num_threads=1)
        return

    def with_offsets(x: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = t.encode(x, add_special_tokens=False)
        return e.ids, e.offsets

    small: list[str] = []

    def flush() -> Iterator[list[int]]:
        for e in t.encode_batch_fast(small, add_special_tokens=False):
            yield e.ids
        small.clear()

    size = 0
    for x in texts:
        if len(x) > chunk and _byte_level(path):
            yield from flush()
            yield splice(x, with_offsets, chunk, overlap)
            continue
        small.append(x)
        size += len(x)
        if size > 1 << 20:
            yield from flush()
            size = 0
    yield from flush()


@lru_cache(maxsize=4)
def _byte_level(path: str) -> bool:
    """Only pre-tokenizers whose boundaries are known may be spliced; all others encode whole texts."""
    pre = load(path).pre_tokenizer
    return pre is not None and pre.__class__.__name__ == "ByteLevel" and load(path).normalizer is None


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit in place of its text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows each keep
    theirs; a column that clashes with one of the three is replaced. Narrow: no
    shuffle, one Arrow batch of texts in memory.
    """
    path = path or public_path()
    whole_texts(docs.sparkSession)
    made = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    keep = [c for c in docs.columns if c != text and c not in made.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in keep] + list(made))
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(unused(docs.columns, "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("tokens")
        for b in batches:
            col = b.column(b.num_columns - 1)
            n = [len(ids) for ids in encode_all(col.to_pylist(), path, chunk, overlap)]
            size = pa.compute.binary_length(col).cast(pa.int64())
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, tokens, pa.array([x > limit for x in n], pa.bool_())], names=[*keep, *made.fieldNames()])

    return src.mapInArrow(run, schema)



class Memo:
    """Ids of whole texts by way of their stable pieces.

    A piece is white space and the non-space run after it, without the marks
    that may end the run, which are a piece of their own: white space after
    non-space is ``stable``, and so is a mark after a letter or digit where only
    marks follow up to white space. So the ids of a text are those of its
    pieces. Pieces repeat: a bounded cache of the worker keeps the ids of
    ``most`` pieces at a time, and texts are cut and put together by arrays.
    Pieces are told apart by their bytes, never by a hash alone. Texts with other white space than ASCII's are encoded whole.
    """

    ODD = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    #: Marks of no special string, and no apostrophe; so many at most are cut off.
    MARKS = ".,!?;:%$&*#)"
    FEW = 8

    def __init__(self, path: str, most: int = 1_500_000, longest: int = 40):
        self.t, self.path, self.most, self.longest = load(path), path, most, longest
        self.whole = not (str(path).endswith(".json") and _byte_level(path))
        if not self.whole:
            vocabulary = self.t.get_vocab(with_added_tokens=True)
            self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, k in vocabulary.items():
                self.size[k] = len(token)  # a byte-level token has a character for each byte
        self.mark, self.letter = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[list(self.MARKS.encode())] = True
        self.letter[[c for c in range(128) if chr(c).isalnum()]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.n, self.used = 0, 0
        self.at, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _append(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Adds the ids of pieces and returns their places; piece k has the ids [at[k], at[k + 1])."""
        while self.n + len(size) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(size)] = self.used + np.cumsum(size)
        places = self.n + np.arange(len(size))
        self.n, self.used = self.n + len(size), self.used + len(ids)
        return places

    def _pieces(self, body: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a slice of texts start and end."""
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(body))[: len(start)]
        left = np.flatnonzero(self.mark[body[stop - 1]])
        at = stop[left]
        for _ in range(self.FEW):
            at = np.where((at > start[left]) & self.mark[body[at - 1]], at - 1, at)
        last, ahead = body[at - 1], body[np.maximum(at - 2, 0)]
        latin = (ahead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        begins[at[(at > start[left]) & (self.letter[last] | latin)]] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(body))[: len(start)]

    def _together(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and their numbers, of pieces that all begin with white space and end without: as one text, cut again by bytes."""
        size = end - start
        upto = np.cumsum(size)
        text = body[np.repeat(start - upto + size, size) + np.arange(upto[-1])].tobytes().decode("utf-8")
        ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), upto) + 1, prepend=0)

    def _alone(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [body[a:b].tobytes().decode("utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        made = [e.ids for e in self.t.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([x for ids in made for x in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit numbers."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        if self.whole:
            return [np.array(x, dtype="<u4") for x in encode_all(column.to_pylist(), self.path)]
        odd = pa.compute.match_substring_regex(column, self.ODD).to_numpy(zero_copy_only=False).astype(bool)
        alone = dict(zip(np.flatnonzero(odd).tolist(), encode_all(column.filter(pa.array(odd)).to_pylist(), self.path), strict=True)) if odd.any() else {}
        body, ends = words.raw(pa.compute.if_else(pa.array(odd), "", column) if alone else column)
        if self.n > self.most:
            self._clear()
        space = words.spaces(body)
        start, end = self._pieces(body, ends, space)
        column_of = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(body))), pa.py_buffer(body)])
        coded = column_of.dictionary_encode()
        distinct, back = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        found = distinct.to_pylist()
        places = np.array(list(map(self.place.get, found, repeat(-1))), np.int64)
        new = np.flatnonzero(places < 0)
        body, at = words.raw(distinct)  # from here on, the distinct pieces one after another
        a, b = at[new], at[new + 1]
        kept, inner = b - a <= self.longest, words.spaces(body[a]) & ~words.spaces(body[b - 1])
        state = self.n, self.used
        for keep in (True, False):
            for many, encoded in ((inner, self._together), (~inner, self._alone)):
                k = np.flatnonzero((kept == keep) & many)
                if len(k):
                    places[new[k]] = self._append(*encoded(body, a[k], b[k]))
            if keep:
                self.place.update(zip([found[k] for k in new[kept].tolist()], places[new[kept]].tolist(), strict=True))
                state = self.n, self.used
        places = places[back]
        low = self.at[places]
        size = self.at[places + 1] - low
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(low - upto[:-1], size) + np.arange(upto[-1])].astype("<u4")
        self.n, self.used = state
        cut = upto[np.searchsorted(start, ends)]
        return [np.array(alone[k], dtype="<u4") if k in alone else ids[cut[k] : cut[k + 1]] for k in range(len(column))]


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    worker.holds("tokens", memo.cache_clear)
    return Memo(path)
