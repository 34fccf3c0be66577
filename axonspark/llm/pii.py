"""Personal data: base patterns, and more candidates chosen by boosted trees."""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm import worker
from axonspark.llm.names import unused
from axonspark.llm.scratch import whole_texts

#: The base kinds as the digest lists them, then those that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches; each @ is looked at once, so that no text takes more than linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[Span]:
    """A match can only begin where a number does; each number is read once."""
    out = []
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append(m.span())
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base spans, in the order of the digest."""
    found = [("email", s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", s) for s in ips(text)] + [("card", s) for s in cards(text)] + [("phone", s) for s in phones(text)]
    return sorted(((s, k, e) for k, (s, e) in found), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


# -- candidates of high recall ---------------------------------------------------------------------------------------

_NAME, _LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?", r"[A-Za-z0-9-]{1,63}"
_DOT = r"(?:[ ]?[\[({<][ ]?dot[ ]?[\])}>][ ]?|[ ]dot[ ])"
_AT = re.compile(rf"{_NAME}(?:{_DOT}{_NAME}){{0,3}}(?:[ ]?[\[({{<][ ]?at[ ]?[\])}}>][ ]?{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{1,4}}|[ ]at[ ]{_LABEL}(?:{_DOT}{_LABEL}){{1,4}})", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")
_LONG_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9A-Za-z])")
_HEX = r"[0-9A-Fa-f]{1,4}"
_IPV6 = re.compile(rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{3,7}}(?::?{_HEX}){{1,4}}|(?:{_HEX}:){{1,6}}:(?:{_HEX}(?::{_HEX}){{0,5}})?|::(?:{_HEX}:){{0,5}}{_HEX})(?![0-9A-Za-z:])")
_GROUPS = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", re.I)
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{9})(?![0-9A-Za-z-])")


#: Keys, tokens and passwords: long runs of letters and digits, and what is assigned to a telling name.
_KEY = re.compile(r"(?<![0-9A-Za-z_+/=.-])(?=[0-9A-Za-z_+/=-]*[0-9])(?=[0-9A-Za-z_+/=-]*[A-Za-z])[0-9A-Za-z_+/-]{16,}+=*+(?![0-9A-Za-z_])")
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key)[\"']?(?:[ ]?(?:=|:=|:|=>)[ ]?|[ ](?:is|ist|lautet|est|es)[ :]{1,2}|[ ])[\"']?([^\s\"',;]{6,}+)", re.I)
_ASSIGNED_CUES = ("pass", "pwd", "secret", "token", "key")
_PREFIX = re.compile(r"(?:AKIA|ASIA|sk[-_]|pk[-_]|rk[-_]|gh[pousr]_|glpat-|xox[abprs]-|AIza|ya29\.|eyJ)")


_CUES = (" dot ", "[dot", "(dot", "{dot", "<dot", "[ dot", "( dot", "[at", "(at", "{at", "<at", "[ at", "( at")


def candidates(text: str) -> list[tuple[int, str, int]]:
    """Overlapping (start, kind, end) that may be personal data beyond the base spans."""
    found = []
    folded = text.lower()
    if any(x in folded for x in _CUES):
        found += [(m.start(), "email", m.end()) for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        for kind, p in (("phone", _LOCAL_PHONE), ("phone", _LONG_PHONE), ("ip", _IPV6), ("card", _GROUPS), ("iban", _IBAN), ("ssn", _SSN)):
            found += [(m.start(), kind, m.end()) for m in p.finditer(text)]
        found += [(m.start(), "secret", m.end()) for m in _KEY.finditer(text)]
    if any(x in folded for x in _ASSIGNED_CUES):
        found += [(m.start(1), "secret", m.end(1)) for m in _ASSIGNED.finditer(text)]
    return list(dict.fromkeys(found))


def address(text: str) -> bool:
    """Whether this is an address of version 6."""
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def mod97(text: str) -> bool:
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


_WORDS = {
    "phone": frozenset("phone tel telephone call fax mobile cell contact reach whatsapp sms dial telefon tél teléfono rufen".split()),
    "card": frozenset("card visa mastercard credit debit payment pay karte carte tarjeta charge".split()),
    "email": frozenset("mail email e-mail write contact reach address correo courriel send".split()),
    "ip": frozenset("ip ipv6 host server address from client login".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta".split()),
    "ssn": frozenset("ssn social security sin taxpayer".split()),
    "secret": frozenset("token key apikey api_key secret password passwd pwd passphrase credential credentials bearer auth authorization access private".split()),
    "other": frozenset("order invoice version isbn part model serial page ref article build ticket section release date since lot sku case no number nr fig table chapter commit sha sha1 sha256 md5 checksum hash digest uuid revision file url path".split()),
}
_SET = re.compile(r"(?:=|:|>)[ ]?[\"']?$")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    """Format and context of one candidate."""
    body = text[start:end]
    d = _digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    before = [w.lower() for w in _TOKEN.findall(text[max(0, start - 40) : start])][-3:]
    after = [w.lower() for w in _TOKEN.findall(text[end : end + 24])][:2]
    near = set(before) | set(after)
    seps = {c for c in body if not c.isalnum()}
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(d)), float(len(groups)), float(max(groups, default=0)), float(groups[-1] if groups else 0), float(groups[0] if groups else 0),
        float(len(seps)), float("(" in seps or "[" in seps or "{" in seps), float("-" in seps), float("." in seps), float("/" in seps), float(" " in seps),
        float(kind == "card" and 12 <= len(d) <= 19 and luhn(d)), float(kind == "iban" and mod97(body)),
        float(bool(near & _WORDS[kind])), float(bool(near & _WORDS["other"])), float(any(w in _WORDS[kind] for w in before[-1:])),
        float(groups[:1] == [4] and d[:2] in ("19", "20")), float(body.lower().count("dot")), float(kind == "email" and ("at]" in body.lower() or "at)" in body.lower() or "at}" in body.lower() or "at>" in body.lower())),
        float(groups[-3:] == [3, 3, 4]), float(d[:3] in ("000", "666") or d[:1] == "9"), float(body.count("::")),
        float(kind == "secret" and _PREFIX.match(body) is not None), float(kind == "secret" and text[max(0, start - 1) : start] in "\"'"), float(kind == "secret" and _SET.search(text[max(0, start - 6) : start]) is not None),
        float(len(set(body)) if kind == "secret" else 0), float(len(d) / len(body) if kind == "secret" else 0), float(kind == "secret" and body.lower() != body and body.upper() != body), float(kind == "secret" and body.count("/") + body.count("-") + body.count("_")),
        float(re.search(r"(com|org|net|edu|gov|io|de|fr|es|uk|eu)$", body.lower()) is not None), float(text[max(0, start - 1) : start] in "$€£#"),
        float(kind == "ip" and address(body)), float(sum(c in "abcdefABCDEF" for c in body) if kind == "ip" else 0), float(kind == "secret" and not d), float(d[:1] == "0"), float(any(w in _WORDS[kind] for w in before)),
    ]


# -- gradient boosting ------------------------------------------------------------------------------------------------


class Boosted:
    """Logistic gradient boosting of small regression trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list] = []
        self.start = 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        parent = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.least) & (len(rows) - cut - 1 >= self.least)]
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1.0) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1.0) - parent
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return leaf
        side = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[side], depth - 1), self._grow(x, g, h, rows[~side], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * np.array([self._leaf(tree, r) for r in x])
        return self

    @staticmethod
    def _leaf(tree, row) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def probability(self, row: list[float]) -> float:
        s = self.start + self.rate * sum(self._leaf(t, row) for t in self.trees)
        return float(1 / (1 + np.exp(-s)))


def labelled(n: int, seed: int) -> list[tuple[str, int, str, int, int]]:
    """Made-up (text, start, kind, end, personal) for training: each kind in telling, neutral and misleading surroundings."""
    r = random.Random(seed)
    filler = "the of and that with from report table mixed value window seems often after before under people place note when where small large".split()
    word = lambda: r.choice(filler)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def with_luhn(d: str) -> str:
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban(good: bool) -> str:
        bban = num(18)
        check = 98 - int(bban + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
        return f"DE{(check if good else (check + 7) % 97):02d}{bban}"

    def email() -> str:
        a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", "."), ("{at}", ".")])
        local = f"{name()} dot {name()}" if a == " at " and r.random() < 0.4 else f"{name()}.{name()}"
        return f"{local}{a}{name()}{d}{r.choice(['com', 'org', 'net', 'de'])}"

    def short_ip(groups: int) -> str:
        left = [f"{r.randint(1, 65535):x}" for _ in range(groups)]
        return r.choice(["2001:db8", "fe80", ":".join(left), "2a02"]) + "::" + ":".join(f"{r.randint(1, 65535):x}" for _ in range(r.randint(1, 3)))

    def phone() -> str:
        if r.random() < 0.25:
            return f"0{num(r.randint(2, 4))}{r.choice([' ', '/', '-'])}{num(r.randint(6, 8))}"
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4))

    makers = [
        ("email", email, lambda: f"{word()} at {name()} dot {name()}"),
        ("phone", phone, lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(2)}.{num(2)}", f"{num(4)}-{num(4)}-{num(2)}", f"0{num(2)} {num(6)}"])),
        ("ip", lambda: short_ip(r.randint(2, 4)) if r.random() < 0.5 else ":".join(f"{r.randint(1, 65535):x}" for _ in range(8)), lambda: r.choice([f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", "".join(r.choice("abcdef") for _ in range(3)) + "::" + "".join(r.choice("abcdef") for _ in range(3)), "cafe::add", "::bad"])),
        ("card", lambda: ".".join(re.findall("....", with_luhn("4" + num(14)))), lambda: ".".join(num(4) for _ in range(4))),
        ("iban", lambda: r.choice([str.upper, str.upper, str.lower])(iban(True)), lambda: r.choice([str.upper, str.lower])(iban(False))),
        ("ssn", lambda: r.choice(["{:03d}-{:02d}-{:04d}", "{:03d}-{:02d}-{:04d}", "{:03d}{:02d}{:04d}"]).format(r.randint(1, 665), r.randint(1, 99), r.randint(1, 9999)), lambda: r.choice([f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}", num(9)])),
    ]
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    mixed = lambda k, of=signs: "".join(r.choice(of) for _ in range(k - 2)) + r.choice(signs[:52]) + r.choice("0123456789")
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k - 2)) + "a7"

    def secret() -> str:
        return r.choice([lambda: hexed(r.choice([32, 40, 64])), lambda: mixed(r.randint(16, 64)), lambda: r.choice(["AKIA", "sk_live_", "ghp_", "xoxb-", "AIza"]) + mixed(r.randint(16, 36))])()

    def no_secret() -> str:
        path = lambda: "/".join(name() for _ in range(r.randint(3, 5))) + num(2)
        return r.choice([path, lambda: "-".join(name() for _ in range(4)) + "-" + num(4), lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: "_".join(name() for _ in range(3)) + num(2), lambda: num(16) + r.choice("abk")])()

    def given() -> tuple[str, str, int]:
        """A password that is told, or a sentence about passwords."""
        cue = r.choice("password passwd pwd passphrase token secret".split())
        tie = r.choice([" is ", " is ", ": ", "=", " ist "])
        if r.random() < 0.5:
            return cue + tie, r.choice([f"{name()}{num(r.randint(1, 4))}", f"{name().title()}{num(2)}{r.choice('!?#')}", mixed(r.randint(7, 12))]), 1
        return cue + r.choice([" is ", " is ", " "]), r.choice("required wrong missing stored hidden longer always expired public manager policy without between".split()), 0

    makers.append(("secret", secret, no_secret))
    out = []
    for _ in range(n):
        kind, good, bad = r.choice(makers)
        own, other = sorted(_WORDS[kind]), sorted(_WORDS["other"])
        case = r.random()
        if case < 0.5:
            body, cue, y = good(), r.choice(own) if r.random() < 0.7 else word(), 1
        elif case < 0.75:
            body, cue, y = bad(), r.choice(own) if kind == "iban" and r.random() < 0.4 else word() if r.random() < 0.6 else r.choice(other), 0
        else:
            body, cue, y = good() if kind in ("phone", "ssn", "secret") else bad(), r.choice(other), 0
        tie, close = r.choice([(": ", ""), (" ", ""), (" ", ""), (" is ", "")] if kind != "secret" else [(": ", ""), (' = "', '"'), ("=", ""), (" is ", ""), (": '", "'"), (" ", "")])
        if kind == "ssn" and y and re.fullmatch("[0-9]{9}", body):
            y = int(cue in _WORDS["ssn"])  # nothing but the words before it tells such a number from others
        elif kind == "secret" and r.random() < 0.3:
            cue, body, y = given()
            tie = close = ""
        left = " ".join(word() for _ in range(r.randint(2, 6))) + f" {cue}{tie}"
        text = left + body + close + " " + " ".join(word() for _ in range(3))
        for s, k, e in candidates(text):
            if s < len(left) + len(body) and e > len(left):
                out.append((text, s, k, e, int(y and k == kind)))
    return out


@lru_cache(maxsize=1)
def model(n: int = 4000, precision: float = 0.98) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the lowest threshold that keeps ``precision`` on held-out examples (over 1: the kind adds none)."""
    rows = labelled(n, 1)
    trees = Boosted().fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float))
    held = labelled(n, 2)
    p = np.array([trees.probability(features(*r[:4])) for r in held])
    kind, y = np.array([r[2] for r in held]), np.array([r[4] for r in held])
    cut = {}
    for k in KINDS:
        mine = np.flatnonzero(kind == k)
        order = mine[np.argsort(-p[mine], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        last = np.flatnonzero((right >= precision) & (np.append(p[order][1:], -1) < p[order])) if len(order) else []
        cut[k] = max(0.5, float(p[order][last[-1]])) if len(last) else 2.0
    return trees, cut


def spans(text: str, chosen: tuple[Boosted, dict[str, float]]) -> tuple[list, list]:
    """(base spans, all spans): those the trees choose come best first and touch neither a base span nor each other."""
    sure = base(text)
    more = candidates(text)
    if not more:
        return sure, sure
    trees, cut = chosen
    rated = [(trees.probability(features(text, *c)), c) for c in more]
    taken = sorted({(s, e) for s, _, e in sure})
    out = list(sure)
    busy = _Intervals(taken)
    for p, c in sorted(rated, key=lambda x: (-x[0], x[1])):
        if p >= cut[c[1]] and busy.add(c[0], c[2]):
            out.append(c)
    return sure, sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


class _Intervals:
    """Disjoint unions of half-open intervals."""

    def __init__(self, found: list[Span]):
        self.low: list[int] = []
        self.high: list[int] = []
        for s, e in found:
            if self.low and s <= self.high[-1]:
                self.high[-1] = max(self.high[-1], e)
            else:
                self.low.append(s)
                self.high.append(e)

    def add(self, s: int, e: int) -> bool:
        k = bisect_right(self.low, s)
        if (k and self.high[k - 1] > s) or (k < len(self.low) and self.low[k] < e):
            return False
        self.low.insert(k, s)
        self.high.insert(k, e)
        return True


def joined(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list) -> str:
    """``text`` with each span (overlapping ones together) replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", clean: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans; with ``clean`` its text is redacted, else dropped.

    Null and empty texts have no spans; repeated rows each keep theirs; columns
    named like the added ones are replaced; an empty table gives an empty
    result. Narrow: no shuffle, one text at a time. The trees are trained on the
    driver, on made-up examples, and go with the tasks.
    """
    whole_texts(docs.sparkSession)
    made = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    names = [f.name for f in made]
    keep = [c for c in docs.columns if c not in names and (c != text)]
    body = unused(docs.columns, "clean_text")
    tail = [T.StructField(body, T.StringType())] if clean else []
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))

    chosen = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin("pii")
        for b in batches:
            rows = []
            for x in b.column(b.num_columns - 1):
                x = x.as_py()
                sure, every = spans(x, chosen)
                n = [sum(k == kind for _, k, _ in sure) for kind in BASE] if sure else [0, 0, 0, 0]
                rows.append((*n, hashlib.sha256(joined(sure).encode()).hexdigest(), joined(every), *([redact(x, every)] if clean else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) + clean)
            kinds = [*[pa.int64()] * 4, *[pa.string()] * (2 + clean)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*keep, *names, *[body] * clean])

    out = src.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + made + tail))
    return out.select(*[F.col(body).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c in keep or (clean and c == text)], *names)
