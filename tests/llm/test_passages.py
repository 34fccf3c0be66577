"""Operators 11 to 13 against brute force: benchmark passages, the resampling draw, periodic runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llm_helpers import WORD, fold
from pyspark.sql import functions as F

from axonspark.llm import leaks, periodic, registry, resample

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words string, Score int, runs int"


def plain(text):
    return PLAIN.findall(fold(text))


def rows_of(texts):
    return [(k, t, "x", 1, 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def benchmark():
    r = random.Random(8)
    some = lambda n: " ".join(f"q{r.randint(0, 400)}" for _ in range(n))
    texts = [some(r.randint(10, 40)) for _ in range(20)] + ["Yes", "yes no", "", None, "?!", "É é x", some(9), some(10)]
    return [(k, t) for k, t in enumerate(texts)] + [(2, "another text of item two that has eleven words in it"), (None, "a row without any id has ten words or more here"), (5, texts[5])]


@pytest.fixture(scope="module")
def texts(benchmark):
    r = random.Random(9)
    some = lambda n: " ".join(f"w{r.randint(0, 3000)}" for _ in range(n))
    known = [t for _, t in benchmark if t and len(plain(t)) >= 9]
    out = ["", None, " \n", "no, YES.", "é É X", "x" * 4000, some(12000)]
    for _ in range(120):
        t = r.choice(known)
        w = t.split()
        a = r.randint(0, max(0, len(w) - 9))
        part = " ".join(w[a : a + r.randint(8, 30)])
        out.append(f"{some(r.randint(0, 40))} {r.choice(['', '«'])}{part.upper() if r.random() < 0.5 else part.replace(' ', r.choice([' ', ', ', chr(10)]))}; {some(r.randint(0, 40))}")
    out += [out[9], out[9], " ".join(known[:3])]
    for _ in range(40):
        base = [f"v{r.randint(0, 6)}" for _ in range(r.randint(1, 9))]
        out.append(" ".join(base * r.randint(1, 12) + base[: r.randint(0, len(base))] + [f"v{r.randint(0, 6)}" for _ in range(r.randint(0, 60))] + base * r.randint(0, 9)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts, benchmark):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([*rows_of(texts), (3, texts[3], "x", 1, 2), (None, "no id, yes", None, None, None)], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# -- benchmark passages ----------------------------------------------------------------------------------------------


def hits(text, benchmark):
    """(words, hit words, items) by looking at every place."""
    w, hit, items = plain(text), set(), set()
    for item, t in benchmark:
        v = plain(t)
        for k in range(max(1, len(v) - 9)) if v else ():
            x = v[k : k + 10]
            at = [i for i in range(len(w) - len(x) + 1) if w[i] == x[0] and w[i : i + len(x)] == x]
            for i in at:
                hit.update(range(i, i + len(x)))
            if at and item is not None:
                items.add(str(item))
    return len(w), hit, sorted(items)


def test_contamination_query(spark, folder, benchmark):
    want = Counter()
    for i, t in documents(spark, folder):
        n, hit, items = hits(t, benchmark)
        want[(i, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))] += 1
    got = Counter(tuple(r) for r in registry.op11_decontamination(spark, folder).collect())
    assert got == want and sum(v for k, v in want.items() if k[5]) > 60


def test_contamination_spans_and_blocks(spark, texts, benchmark):
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    one = leaks.contamination(docs, items).collect()
    assert leaks.contamination(docs, items).columns == ["doc_id", "text", "Score", "runs", "n_words", "n_hit", "items", "spans"]
    many = leaks.contamination(docs, items, block=60).collect()
    key = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans) for r in rows)
    assert key(one) == key(many)
    for r in one:
        n, hit, _ = hits(r.text, benchmark)
        assert sum(len(plain(r.text[s.start : s.end])) for s in r.spans) == len(hit) and r.n_words == n
        places = [m.span() for m in PLAIN.finditer(fold(r.text))]
        stretches = [(a, b) for a, b in places if any(s.start <= a and b <= s.end for s in r.spans)]
        assert [places[k] for k in sorted(hit)] == stretches


def test_contamination_empty(spark, benchmark):
    docs, none = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"], r.spans) for r in leaks.contamination(docs, none).collect()] == [(2, 0, [], [])]
    assert leaks.contamination(docs.limit(0), spark.createDataFrame(benchmark, "item_id long, text string")).count() == 0


# -- resampling ------------------------------------------------------------------------------------------------------


def drawn(docs, target, n=1, buckets=10000, percent=10, least=20):
    """The contract, line by line."""
    runs = lambda w: [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, len(plain(t)), [bucket(f) for f in runs(plain(t))]) for i, t in docs]
    s, t = Counter(b for _, _, x in own for b in x), Counter(bucket(f) for x in target for f in runs(plain(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for i, words, x in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        out.append((i, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-sc, i is None, i or 0, f, k) for k, (i, w, f, _, sc) in enumerate(out) if w >= least)
    place = {e[-1]: p + 1 for p, e in enumerate(able[: percent * len(able) // 100])}
    return Counter((i, f, w, sc, place.get(k)) for k, (i, _, f, w, sc) in enumerate(out))


@pytest.mark.parametrize("n,buckets,percent,least", [(1, 10000, 10, 20), (3, 97, 100, 0), (2, 100_000, 35, 1)])
def test_resampling(spark, folder, benchmark, n, buckets, percent, least):
    target = [t for _, t in benchmark]
    want = drawn(documents(spark, folder), target, n, buckets, percent, least)
    if (n, buckets) == (1, 10000):
        got = registry.op12_resampling(spark, folder)
    else:
        got = resample.resample(spark.read.parquet(f"{folder}/documents.parquet").repartition(7), spark.read.parquet(f"{folder}/benchmark.parquet"), n=n, buckets=buckets, percent=percent, least=least)
        assert got.columns == ["doc_id", "n_words", "runs", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == want
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in rows) + 1))


def test_ring():
    w = [b"a", b"bc", "é".encode(), b"a"]
    want = sorted(zlib.crc32(b" ".join(w[k : k + m])) for m in (1, 2, 3) for k in range(5 - m))
    assert sorted(resample.ring(w, 3).tolist()) == want and resample.ring([], 2).tolist() == []
    assert resample.ring(w, 1).tolist() == [zlib.crc32(x) for x in w] and resample.split("Ab-é 3 z\t") == ["ab".encode(), "é".encode(), "3 z".encode()]


def test_resampling_empty(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert resample.resample(docs, target).count() == 0
    some = spark.createDataFrame([(k, "a b " * 20) for k in range(10)], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(some, target.limit(0)).where("rank is not null").collect()] == [1]


# -- periodic runs ---------------------------------------------------------------------------------------------------


def runs(w, least, times):
    """Every run (start, length, period), by trying all periods."""
    found, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(r):
    kind, n, k = r.random(), r.randint(0, 70), r.choice([1, 2, 2, 3, 4])
    if kind < 0.5:
        return [r.randrange(k) for _ in range(n)]
    if kind < 0.8:
        w = ([r.randrange(5) for _ in range(r.randint(1, 7))] * 20)[:n]
        for _ in range(r.randint(0, 2) if w else 0):
            w[r.randrange(len(w))] = 9
        return w + w[r.randint(0, len(w)) :]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least,times", [(2, 2), (5, 2), (12, 2), (6, 3), (24, 3), (1, 4)])
def test_all_runs(least, times):
    r = random.Random(least)
    for _ in range(120):
        docs = [made(r) for _ in range(r.randint(1, 5))]
        first = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        symbols = np.array([k << 32 | x for k, w in enumerate(docs) for x in w], np.int64)
        got = [(s, e - s, p) for s, e, p in periodic.runs(symbols, first, least, times).tolist()]
        assert got == sorted((s + int(first[k]), n, p) for k, w in enumerate(docs) for s, n, p in runs(w, least, times)), docs


def test_long_repeats():
    r = np.random.default_rng(1)
    for w, n in ((np.zeros(200_000, np.int64), 1), (np.arange(200_000) % 7, 1), (np.tile(r.integers(0, 5000, 1000), 200), 1), (np.concatenate([r.integers(0, 3000, 100_000)] * 2), 0)):
        assert len(periodic.runs(w.astype(np.int64), np.array([0, len(w)]), 24, 3)) == n


def test_runs_query(spark, folder):
    want = Counter()
    for i, t in documents(spark, folder):
        w = WORD.findall(t or "")
        h = zlib.crc32(str("" if i is None else i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = runs(w, 24, 3)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in registry.op13_periodic_runs(spark, folder).collect())
    assert got == want and sum(k[1] > 0 for k in want) > 10


def test_runs_operator(spark, texts):
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(2)
    out = periodic.periodic_runs(docs, least=2, times=2)
    assert out.columns == ["doc_id", "text", "n_words", "Score", "runs", "strongest", "collapsed"]
    for r in out.collect():
        w = WORD.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == (runs(w, 2, 2) if len(w) < 2000 else [tuple(x) for x in r.runs])
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    again = periodic.periodic_runs(docs.select("doc_id", F.concat_ws(" ", "text", F.lit("z")).alias("text")), rewrite=lambda i, n: (0, 1) if n > 30 else None, carry=["doc_id"])
    assert all(len(r.collapsed.split()) == 1 or not r.strongest for r in again.collect())
