"""Operators on single texts and on pairs of texts, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import WORD, fold, shingles
from pii_sentences import SENTENCES
from pyspark.sql import functions as F

from axonspark.llm import jaccard, packing, pii, spans, tokens, words
from axonspark.llm.graph import components
from axonspark.llm.scratch import Scratch


def test_word_hashes():
    import pyarrow as pa

    texts = ["The cat", None, "", "  the\tCAT \n", "the cat the", "b " * 3]
    body, ends = words.raw(pa.array(texts, pa.large_string()))
    start, end, first = words.spans(body, ends)
    assert np.diff(first).tolist() == [2, 0, 0, 2, 3, 3]
    h = words.hashes(body, start, end)
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(set(words.hashes(body, start, end, fold=False).tolist())) == 5
    values, at = words.shingle_sets(pa.array(texts, pa.large_string()), 2)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 2, 1] and values[at[0]] == values[at[3]]


def twins(n=1024, one="a", other="b", by=""):
    """Two sequences in Thue-Morse order and its complement, which polynomials modulo a power of two don't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return by.join(one if x else other for x in bits), by.join(other if x else one for x in bits)


def test_no_pattern_cancels_out(spark):
    import pyarrow as pa

    pair, run = twins(), twins(by=" ")
    body, ends = words.raw(pa.array([*pair, *twins(4096), "x" * 8, "x" * 16, "x" * 17, "x" * 16 + "y"], pa.large_string()))
    for second in (False, True):
        assert len(set(words.hashes(body, *words.spans(body, ends)[:2], second=second).tolist())) == 8
    a, b = (spans.Sentences(pa.array([x + "."], pa.large_string()), 20) for x in run)
    assert not set(a.hash.tolist()) & set(b.hash.tolist()) and not set(a.check.tolist()) & set(b.check.tolist())
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, pair[0]), (4, run[0] + "."), (5, run[1] + "."), (6, run[1] + ".")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(docs.where("doc_id < 4")).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: len(r.text) for r in spans.remove_repeats(docs).collect()} == {1: 1024, 2: 1024, 3: 1024, 4: 2048, 5: 2048, 6: 0}
    library = tokens.load(tokens.public_path())
    made = tokens.Memo(tokens.public_path(), longest=2000).encode([pair[0], pair[1], f"z {pair[1]} {pair[0]}"])
    assert [x.tolist() for x in made] == [library.encode(x, add_special_tokens=False).ids for x in (pair[0], pair[1], f"z {pair[1]} {pair[0]}")]


def test_pieces_are_told_apart_by_their_bytes(library, monkeypatch):
    monkeypatch.setattr(words, "hashes", lambda body, start, end, **_: np.zeros(len(start), np.uint64))
    made = tokens.Memo(tokens.public_path()).encode(ODD)
    assert [x.tolist() for x in made] == [library.encode(x, add_special_tokens=False).ids for x in ODD]


# -- token counts ----------------------------------------------------------------------------------------------------

ODD = ["a\n  b   c \n d\t\te  ", "  lead", "", "<|endoftext|> x <|endoftext|>y", " \x1c a\x1f b", "é ü  中文 字 ", "x" * 700, " " * 60, " nb em  z", "it's 'll  we're\n\n\nok", "a, b. a b! (b). 3.14, it's. é! ²; ... ,x ok%%% <|endoftext|>. end|>, '.", "b, b. b"]


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.public_path())


def test_splice(library):
    def encode(x):
        e = library.encode(x, add_special_tokens=False)
        return e.ids, e.offsets

    r = random.Random(1)
    for k in range(60):
        text = "".join(r.choice([" ", "  ", "\n", "ab", "é", "9", "'s", "<|endoftext|>", "!", "中", "x" * 30]) for _ in range(r.randint(1, 300)))
        assert tokens.splice(text, encode, 40, 4) == encode(text)[0], k
    assert tokens.splice("x" * 900 + " a b", encode, 50, 4) == encode("x" * 900 + " a b")[0]


def test_memo(library):
    m = tokens.Memo(tokens.public_path(), most=50)
    for _ in range(3):
        assert [x.tolist() for x in m.encode(ODD)] == [library.encode(x, add_special_tokens=False).ids for x in ODD]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, mixed, name):
    path = tokens.public_path(name)
    t = tokens.load(path)
    n = lambda x: len(t.encode(x) if name.endswith("model") else t.encode(x, add_special_tokens=False).ids)
    got = tokens.token_counts(mixed.withColumn("n_tokens", F.lit("clash")), path, limit=100, chunk=2000, overlap=8)
    assert got.columns == ["doc_id", "source", "row", "size", "score", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r.doc_id, len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 100) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


# -- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[1]), x[2]))


def test_base_spans():
    r = random.Random(2)
    parts = ["a", "@", ".", "b.c", "1", "12", "255.", "256", "+1 (", ") 555-", " ", "-", "%x", "4111 1111 1111 1111", "é", "00", "+", "x@y.z"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.base(text) == plain_base(text), text


def test_trees_hold_out():
    trees, cut = pii.model()
    held = pii.labelled(1500, 3)
    said = [trees.probability(pii.features(*r[:4])) >= cut[r[2]] for r in held]
    right = sum(s == bool(r[4]) for s, r in zip(said, held, strict=True))
    assert right / len(held) > 0.95
    assert sum(s and not r[4] for s, r in zip(said, held, strict=True)) <= 0.02 * len(held)


def test_added_spans():
    m = pii.model()
    for text, kinds in {"call me at (555) 123-4567 today": ["phone"], "SSN: 123-45-6789 ok": ["ssn"], "mail john.doe [at] example [dot] com": ["email"], "IBAN DE89370400440532013000 now": ["iban"], "on 2024-01-15 we": [], "order 123-456-7890": [], "met at noon. Then left": []}.items():
        assert [k for _, k, _ in pii.spans(text, m)[1]] == kinds, text
    assert pii.redact("a x@y.zz b", pii.base("a x@y.zz b")) == "a [EMAIL] b"


def test_find(mixed):
    more = mixed.withColumn("text", F.concat("text", F.lit(" q@w.de +49 30 1234567 10.0.0.1")))
    got = pii.find(more)
    assert got.count() == more.count() and "text" not in got.columns
    for r, t in zip(got.orderBy("doc_id", "score").collect(), more.orderBy("doc_id", "score").collect(), strict=True):
        base = plain_base(t.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in pii.BASE)
        assert set(f"{k}:{s}:{e}" for s, k, e in base) <= set(r.spans.split(",")) or not base
    clean = pii.find(more.withColumn("spans", F.lit(1)), clean=True)
    assert not any("q@w.de" in (r.text or "") for r in clean.collect())


def test_long_texts_take_linear_time():
    import time

    m = pii.model()
    for x in ("a" * 200_000, "1" * 200_000, "1.1" * 70_000, "+1" * 100_000, "a@" * 100_000, "1-" * 100_000, "1:" * 100_000):
        t = time.time()
        pii.spans(x, m)
        assert time.time() - t < 5


# -- substring dedup -------------------------------------------------------------------------------------------------


def sentences(t):
    ws = [m.span() for m in WORD.finditer(t)]
    out, cur = [], []
    for k, (a, b) in enumerate(ws):
        cur.append((a, b))
        core = t[a:b]
        for _ in range(3):
            core = core[:-1] if len(core) > 1 and core[-1] in "\"')]}" else core
        nxt = ws[k + 1][0] if k + 1 < len(ws) else None
        if core[-1] in ".!?…" or nxt is None or re.search("[\n\r]", t[b:nxt]):
            out.append(cur)
            cur = []
    return out


def plain_dedup(docs, least):
    occ, info = defaultdict(list), {}
    for key, t in docs:
        s = sentences(t)
        runs = set()
        for i in range(len(s)):
            for step in (1, -1):
                j, n = i, 0
                while 0 <= j < len(s):
                    n += len(s[j])
                    if n >= least:
                        runs.add((min(i, j), max(i, j) + 1))
                        break
                    j += step
        info[key] = (t, s)
        for a, b in runs:
            occ[tuple(fold(t[x:y]) for z in s[a:b] for x, y in z)].append((key, a, b))
    gone = defaultdict(set)
    for v in occ.values():
        for key, a, b in sorted(v)[1:]:
            gone[key] |= set(range(a, b))
    out = {}
    for key, (t, s) in info.items():
        keep = t[: s[0][0][0]] if s else t
        for k, z in enumerate(s):
            if k not in gone[key]:
                keep += t[z[0][0] : s[k + 1][0][0] if k + 1 < len(s) else len(t)]
        out[key] = (keep, len(s), len(gone[key]))
    return out


def test_remove_repeats(spark):
    r = random.Random(9)
    line = lambda: " ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 9))) + r.choice([".", "!", "?)", "…", "\n", ". "])
    shared = [" ".join(line() for _ in range(14)) for _ in range(4)]
    docs = []
    for k in range(120):
        parts = [line() for _ in range(r.randint(0, 12))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        docs.append((k, " ".join(parts)))
    docs += [(200, docs[5][1]), (201, docs[5][1].upper()), (202, "x " * 200), (203, "a. " * 50), (204, ""), (205, "\n \n")]
    r.shuffle(docs)
    df = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id long, text string, n_removed string").repartition(3)
    want = plain_dedup(docs, 20)
    got = {x.doc_id: (x.text, x.n_sentences, x.n_removed) for x in spans.remove_repeats(df).collect()}
    assert got == want
    assert sum(v[2] > 0 for v in want.values()) > 40


def test_a_passage_is_caught_wherever_it_stands(spark):
    r = random.Random(3)
    some = lambda n: " ".join(f"q{r.randint(0, 99999)}" for _ in range(n))
    passage = ". ".join(some(n) for n in (9, 14, 8, 12, 11, 7)) + "."
    docs = [(k, f"{some(7)}. {some(5)} {passage} {some(6)}. {some(8)}.") for k in range(5)] + [(9, f"{some(30)}. {some(12)}.")]
    out = {x.doc_id: x for x in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].text == docs[0][1] and out[9].text == docs[5][1]
    assert all(out[k].n_removed >= 4 and len(out[k].text) < len(docs[k][1]) / 1.5 for k in range(1, 5))


def test_nothing_goes_from_unique_text_at_volume(spark):
    """About 1.6 million different runs in 60 MB: a key of few bits would take some of them for repeats."""
    word = lambda i: F.concat(F.lower(F.hex(F.col("id") * 600 + i)), F.when(i % 6 == 5, ".").otherwise(""))
    docs = spark.range(0, 14000, 1, 8).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(599)), word), " ").alias("text"))
    out = spans.remove_repeats(docs).agg(F.sum("n_sentences"), F.sum("n_removed"), F.count("*")).first()
    assert tuple(out) == (1_400_000, 0, 14000)


def test_remove_repeats_mixed(mixed):
    out = spans.remove_repeats(mixed)
    assert out.columns == [*mixed.columns, "n_sentences", "n_removed"] and out.count() == mixed.count()
    assert all(x.text == "" for x in out.join(mixed.where("text is null").select("doc_id"), "doc_id").collect())


def test_runs_that_share_the_low_bits_of_their_hash(spark):
    import pyarrow as pa

    r = np.random.default_rng(11)
    texts = [" ".join(map(str, x)) + "." for x in r.integers(0, 100000, (250_000, spans.LEAST_WORDS)).tolist()]
    s = spans.Sentences(pa.array(texts, pa.large_string()), spans.LEAST_WORDS)
    assert len(s.hash) == len(texts)
    low = s.hash.astype(np.uint32)
    order = np.argsort(low, kind="stable")
    at = int(np.flatnonzero(low[order][1:] == low[order][:-1])[0])
    x, y = order[at : at + 2].tolist()
    assert low[x] == low[y] and s.hash[x] != s.hash[y] and texts[x] != texts[y]
    docs = [(1, texts[x]), (2, texts[y]), (3, f"{texts[y]} more of it.")]
    out = {d.doc_id: (d.text, d.n_removed) for d in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: (texts[x], 0), 2: (texts[y], 0), 3: ("more of it.", 1)}


def test_runs_that_share_the_first_hash():
    import pyarrow as pa

    u = lambda *x: np.array(x, np.uint64)
    a = spans.pack(u(5, 5, 2**63), u(1, 3, 9), np.array([1, 1, 1]))
    b = spans.pack(u(5, 5, 2**63 + 2**32), u(2, 3, 9), np.array([2, 2, 2]))
    assert [x.tolist() for x in spans.unpack(b)] == [[5, 5, 2**63 + 2**32], [2, 3, 9], [2, 2, 2]]
    got = spans._answer(pa.table({"chunk": [7, 8], "block": pa.array([0, 0], pa.int32()), "payload": pa.array([a, b], pa.binary())}))
    assert [(c, [x.tolist() for x in spans.unpack(p)]) for c, p in zip(got["chunk"].to_pylist(), got["payload"].to_pylist(), strict=True)] == [(7, [[5], [3], [1]]), (8, [[5], [3], [0]])]
    place, found = spans._find(u(5, 5, 5, 8), u(1, 3, 6, 2), u(5, 8, 5, 5, 8, 9), u(6, 2, 1, 4, 3, 2))
    assert found.tolist() == [0, 1, 2] and place.tolist() == [2, 3, 0]


# -- n-gram join -----------------------------------------------------------------------------------------------------


def plain_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    inverse, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in inverse[x])
        for j, o in common.items():
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            inverse[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [64, 2])
def test_ngram_jaccard(mixed, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard.ngram_jaccard(mixed)
    assert got.count() == mixed.count()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert rows.pop(None) == (1, None)
    want = plain_components({r.doc_id: r.text for r in mixed.where("doc_id is not null").collect()}.items())
    assert rows == want and len({c for _, c in want.values()}) < len(want) - 60


def test_same_id_is_one_node(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(5, a), (7, a), (7, b), (9, b), (3, "other text")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(df).collect()} == {5: 5, 7: 5, 9: 5, 3: 3}


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)] + [(300, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root if x != 300}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# -- packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 400, 5000])
def test_plan(n):
    r = random.Random(n)
    h = Counter(min(255, max(1, int(r.lognormvariate(4, 1)))) for _ in range(n))
    out, opened = packing.plan(h, 256)
    filled, covered = defaultdict(list), defaultdict(list)
    for kind, low, high, start, length, base, offset in out:
        for k in range(high - low):
            filled[base + k].append((offset, length))
            covered[kind, low + k].append((start, length))
    for pieces, full in ((filled, None), (covered, 0)):
        for key, v in pieces.items():
            at = 0
            for a, b in sorted(v):
                assert a == at
                at += b
            assert at == key[0] if full == 0 else at <= 256
    assert len(covered) == n and len(filled) == opened == -(-sum(k * c for k, c in h.items()) // 256)


def test_pack(spark, mixed, library):
    out = packing.pack(mixed, size=128)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = Counter()
    for r in mixed.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        docs[(r.doc_id, len(ids), ids.tobytes())] += 1
    rows = out.collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(n * c for (_, n, _), c in docs.items())
    assert sum(r.length for r in rows) == total and len(sequences) * 128 - total < 128 and set(sequences) == set(range(len(sequences)))
    found = defaultdict(Counter)
    for r in rows:
        found[r.doc_id, r.doc_tokens][r.start, r.length, r.ids_crc32] += 1
    for (i, n, body), c in docs.items():
        ids = np.frombuffer(body, "<u4")
        for (start, length, crc), _ in found[i, n].items():
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
        cover = Counter()
        for (start, length, _), k in found[i, n].items():
            for at in range(start, start + length):
                cover[at] += k
        assert all(cover[at] == c for at in range(n))


def family(r, size, changed, count, words):
    """Texts of one template with ``changed`` words each replaced."""
    base, out = [f"b{k}" for k in range(size)], []
    for _ in range(count):
        x = base[:]
        for k in r.sample(range(size), changed):
            x[k] = r.choice(words)
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("few", ["all in one label", "every label its own"])
def test_families_just_below_the_threshold(spark, monkeypatch, few):
    """400 texts of one template at a similarity of about 0.75, some of them linked: no quadratic pairs, in bounded time."""
    r = random.Random(7)
    rows = list(enumerate(family(r, 180, 3, 400, [f"v{k}" for k in range(6)])))
    if few == "every label its own":
        rows = rows[:90]
        monkeypatch.setattr(jaccard, "FEW", 16)
        monkeypatch.setattr(jaccard, "_labelled", lambda todo, scratch: scratch.keep(todo.withColumn("label", F.col("digest")), "todo"))
    made = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": made.append((name, keep(self, df, name))) or made[-1][1])
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    began = time.time()
    got = {x.doc_id: x.component_id for x in jaccard.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 240
    assert got == {k: c for k, (_, c) in plain_components(rows).items()}
    assert 1 < len(set(got.values())) < len(rows)
    if few == "all in one label":
        assert sum(t.count() for name, t in made if name == "pairs") <= 12 * len(rows)


def test_product_block():
    r = random.Random(2)
    sets = [sorted(r.sample(range(40), r.randint(0, 25))) for _ in range(60)]
    sets += [sets[3], sets[4][:-1], sets[5] + [99]]
    first = np.cumsum([0, *map(len, sets)])
    left, right = np.arange(len(sets)) % 3 > 0, np.arange(len(sets)) % 4 > 0
    got = jaccard.multiply(np.array([x for s in sets for x in s], np.uint64), first, left, right, 60, 100)
    links = {(a, b) for a in np.flatnonzero(left) for b in np.flatnonzero(right) if a != b and sets[a] and 100 * len({*sets[a]} & {*sets[b]}) >= 60 * len({*sets[a]} | {*sets[b]})}
    assert {*got} <= links and len(got) < len(sets)
    root = {k: {k} for k in range(len(sets))}
    for a, b in got:
        both = root[a] | root[b]
        for k in both:
            root[k] = both
    assert all(b in root[a] for a, b in links)


def marked(sentence):
    """(text, spans) of a sentence whose spans stand in [[kind|text]]."""
    text, found = "", []
    for part in re.split(r"(\[\[\w+\|.*?\]\])", sentence):
        m = re.fullmatch(r"\[\[(\w+)\|(.*)\]\]", part)
        if m:
            found.append((len(text), m[1], len(text) + len(m[2])))
        text += m[2] if m else part
    return text, found


def test_added_spans_on_sentences_labelled_by_hand():
    same = lambda a, b: a[1] == b[1] and a[0] < b[2] and b[0] < a[2]
    asked = made = right = caught = 0
    for s in SENTENCES:
        text, want = marked(s)
        sure, every = pii.spans(text, pii.model())
        want = [w for w in want if not any(w[0] < b[2] and b[0] < w[2] for b in sure)]
        more = [x for x in every if x not in sure]
        asked, made = asked + len(want), made + len(more)
        caught += sum(any(same(w, g) for g in more) for w in want)
        right += sum(any(same(g, w) for w in want) for g in more)
    assert asked >= 20 and caught >= 0.9 * asked and right >= 0.9 * made
