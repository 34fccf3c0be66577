"""Main text of web pages: a tree-structured graphical model over the DOM.

Every element is content or not. Its own potential comes from its tag, its
attributes' words, the length of its text, the share of it inside links and its
share of the page's text outside links; parent and child share a potential that depends on the child's kind. Sum-product
messages go up from the leaves and down from the root and give every element's
exact marginal. The weights are fitted by maximum likelihood, with the same
messages, to labelled pages that ``labelled_page`` makes up.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark.llm.names import unused
from axonspark.llm.scratch import whole_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("script style title noscript template iframe noembed noframes head svg annotation annotation-xml object select option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul tr td th tbody thead tfoot caption body html".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
_TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: One attribute with its value, whatever its name: so that no name is ever looked for inside the value of another.
_ATTR = re.compile(r"([^\s\"'=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?|\"[^\"]*+\"|'[^']*+'")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Dom:
    """Elements in page order: tag, attributes and parent of each; and the page's texts with their elements."""

    __slots__ = ("attrs", "parent", "tag", "texts")

    def __init__(self, page: str):
        self.tag, self.attrs, self.parent = ["html"], [""], [-1]
        self.texts: list[tuple[int, str]] = []
        stack, at, n = [0], 0, len(page)
        lower = None
        blind = -1
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self._text(stack, page[at:])
                break
            if lt > at:
                self._text(stack, page[at:lt])
            c = page[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = n if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
            elif c == "/":
                end = page.find(">", lt)
                if end < 0:
                    break
                self._end(stack, page[lt + 2 : end].split(None, 1)[0].lower() if page[lt + 2 : end].strip() else "")
                at = end + 1
            elif c.isalpha() and c.isascii():
                m = _TAG.match(page, lt + 1) if lt > blind else None
                if m is None:
                    blind = max(blind, page.rfind('"'), page.rfind("'"))
                    end = page.find(">", lt)
                    if end < 0:
                        break
                    inside = page[lt + 1 : end]
                    name, _, attrs = inside.partition(" ")
                    at = end + 1
                else:
                    name, attrs, at = m[1], m[2], m.end()
                name = name.lower()
                self._start(stack, name, attrs)
                if name in RAW:
                    if lower is None:
                        lower = page.lower()
                        if len(lower) != n:
                            lower = "".join(x.lower() if x.isascii() else x for x in page)
                    end = lower.find(f"</{name}", at)
                    if end < 0:
                        end = n
                    close = page.find(">", end)
                    at = n if close < 0 else close + 1
                    stack.pop()
            else:
                self._text(stack, "<")
                at = lt + 1

    def _text(self, stack: list[int], text: str) -> None:
        self.texts.append((stack[-1], text))

    def _start(self, stack: list[int], name: str, attrs: str) -> None:
        if name in ("html", "body") and name in (self.tag[k] for k in stack):
            return
        if name in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t == "p":
                    del stack[k:]
                    break
                if t in BLOCKS:
                    break
        closes = _CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in closes:
                    del stack[k:]
                    break
                if t in _SCOPE[name]:
                    break
        if name == "body":
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "head":
                    del stack[k:]
                    break
        if name == "html":
            return
        if name == "br":
            self.texts.append((stack[-1], "\n"))
        self.tag.append(name)
        self.attrs.append(attrs)
        self.parent.append(stack[-1])
        if name not in VOID and not attrs.endswith("/") or name in BLOCKS and name not in VOID:
            stack.append(len(self.tag) - 1)

    def _end(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t == name:
                del stack[k:]
                return
            if name in INLINE and t in BLOCKS:
                return


@lru_cache(maxsize=50_000)
def described(tag: str, attrs: str) -> tuple[tuple[str, ...], str, bool]:
    """(features, kind of the edge to the parent, hidden) of an element by its tag and attributes."""
    out, tokens, hidden = [f"tag:{tag}"], set(), False
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                tokens |= {tuple(w.lower() for w in _WORD.findall(x)) for x in value.split()}
            elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    for token in sorted(tokens):
        groups = [_groups(w) for w in token]
        # a name made of such words and of words for parts of pages says what the element is; any other may only sound like it
        sure = all(g or w in PARTS or len(w) < 3 for w, g in zip(token, groups, strict=True))
        out += [f"{'word' if sure else 'maybe'}:{g}" for found in groups for g in found]
    if hidden:
        out.append("hidden")
    group = next((x[5:] for x in out if x.startswith("word:")), None)
    kind = "inline" if tag in INLINE and not group else f"block:{group}" if group else f"tag:{tag}"
    return tuple(dict.fromkeys(out)), kind, hidden


@lru_cache(maxsize=50_000)
def _groups(word: str) -> tuple[str, ...]:
    return tuple(group for group, stems in GROUPS.items() if any(word == s or (len(s) > 4 and word.startswith(s)) for s in stems))


#: Words of class, id, role and label by what they say of an element.
GROUPS = {
    "menu": "nav navbar navigation menu menubar menue breadcrumb breadcrumbs pagination pager toc skip tabs".split(),
    "head": "header masthead banner topbar logo branding kopfzeile kopf entete cabecera testata".split(),
    "foot": "footer contentinfo copyright legal colophon fuss fusszeile fussbereich impressum pied pie rodape".split(),
    "side": "sidebar side aside complementary rail widget related recommended recommendations trending popular more seitenleiste randspalte lateral laterale".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast paywall disclaimer warning message hinweis avis aviso avviso".split(),
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted dfp taboola outbrain werbung anzeige anzeigen publicite publicidad anuncio pubblicita reklame".split(),
    "form": "form search login signin signup subscribe subscription newsletter register contact formular suche anmeldung recherche connexion buscar".split(),
    "comment": "comment comments discussion disqus reply replies respond reader responses kommentar kommentare commentaire commentaires comentario comentarios commenti".split(),
    "share": "share sharing social facebook twitter tools toolbar actions buttons tags meta byline author teilen partager compartir".split(),
    "main": "article content main post entry story body text prose page richtext markdown artikel beitrag inhalt contenu contenido articolo".split(),
}
#: Words that say only which part or shape an element has.
PARTS = frozenset("list item items box container wrapper wrap block section area inner outer left right top bottom center column col row panel module group bar slot unit zone region view link links title heading icon primary secondary global site web js new posts articles stories news top level bereich spalte liste feld".split())


class Page:
    """A page's DOM with what the model sees of each element."""

    __slots__ = ("dom", "features", "kinds", "order", "silent")

    def __init__(self, html: str):
        d = self.dom = Dom(html)
        n = len(d.tag)
        size, linked = [0] * n, [0] * n
        silent = self.silent = [False] * n
        for k in range(1, n):
            silent[k] = silent[d.parent[k]] or d.tag[k] in SILENT
        for k, t in d.texts:
            if not silent[k]:
                size[k] += len(t) if not t.isspace() else 0
        for k in range(n):
            if d.tag[k] == "a":
                linked[k] = -1
        inside = [False] * n
        for k in range(1, n):
            inside[k] = inside[d.parent[k]] or d.tag[k] == "a"
        links = [s if a else 0 for s, a in zip(size, inside, strict=True)]
        for k in range(n - 1, 0, -1):
            size[d.parent[k]] += size[k]
            links[d.parent[k]] += links[k]
        self.features, self.kinds = [], []
        plain = max(size[0] - links[0], 1)
        for k in range(n):
            static, kind, hidden = described(d.tag[k], d.attrs[k])
            s = size[k]
            length = "0" if s == 0 else "20" if s < 20 else "100" if s < 100 else "400" if s < 400 else "more"
            share = "none" if not s or not links[k] else "some" if links[k] < 0.3 * s else "much" if links[k] < 0.7 * s else "all"
            part = (s - links[k]) / plain
            of_page = "none" if part <= 0 else "5" if part < 0.05 else "20" if part < 0.2 else "50" if part < 0.5 else "80" if part < 0.8 else "most"
            self.features.append((*static, f"length:{length}", f"links:{share}", f"part:{of_page}"))
            self.kinds.append(kind)
            if hidden:
                silent[k] = True
            if k and silent[d.parent[k]]:
                silent[k] = True


def _soft(x: float) -> float:
    """log(1 + e**x)"""
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def _both(a: float, b: float) -> float:
    """log(e**a + e**b)"""
    return a + _soft(b - a)


class TreeModel:
    """Weights of element features, and of parent and child values by kind of edge."""

    def __init__(self):
        self.unary: dict[str, float] = {"bias": 0.0}
        self.edge: dict[str, list[float]] = {"any": [0.5, -0.5, -0.5, 0.5]}
        self._odds: dict[tuple, float] = {}
        self._pair: dict[str, tuple[float, float, float, float]] = {}

    def freeze(self) -> TreeModel:
        self._odds, self._pair = {}, {}
        return self

    def _potential(self, features: tuple[str, ...]) -> float:
        v = self._odds.get(features)
        if v is None:
            v = self._odds[features] = self.unary["bias"] + sum(self.unary.get(f, 0.0) for f in features)
        return v

    def _edge(self, kind: str) -> tuple[float, float, float, float]:
        """Potentials of (parent, child) = 00, 01, 10, 11."""
        v = self._pair.get(kind)
        if v is None:
            own = self.edge.get(kind, (0.0, 0.0, 0.0, 0.0))
            v = self._pair[kind] = tuple(a + b for a, b in zip(self.edge["any"], own, strict=True))
        return v

    def messages(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """(log odds of each element's marginal, its log odds from below, its message to the parent)."""
        parent, kinds = page.dom.parent, page.kinds
        n = len(parent)
        below = [self._potential(f) for f in page.features]
        up = [0.0] * n
        for k in range(n - 1, 0, -1):
            e00, e01, e10, e11 = self._edge(kinds[k])
            b = below[k]
            up[k] = _both(e10, e11 + b) - _both(e00, e01 + b)
            below[parent[k]] += up[k]
        whole = below[:]
        for k in range(1, n):
            e00, e01, e10, e11 = self._edge(kinds[k])
            a = whole[parent[k]] - up[k]
            whole[k] = below[k] + _both(e01, e11 + a) - _both(e00, e10 + a)
        return whole, below, up

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = 25, rate: float = 0.3, shrink: float = 1e-3) -> TreeModel:
        """Maximum likelihood by adaptive gradient steps over pages."""
        seen: dict = {}

        def step(table, key, k, g):
            at = (id(table), key, k)
            seen[at] = seen.get(at, 1e-8) + g * g
            if k is None:
                table[key] = table.get(key, 0.0) * (1 - shrink) + rate * g / seen[at] ** 0.5
            else:
                row = table.setdefault(key, [0.0] * 4)
                row[k] = row[k] * (1 - shrink) + rate * g / seen[at] ** 0.5

        for _ in range(rounds):
            for page, y in pages:
                self.freeze()
                whole, below, up = self.messages(page)
                grad: dict[str, float] = {}
                pair: dict[str, list[float]] = {}
                for k, w in enumerate(whole):
                    d = y[k] - 1 / (1 + exp(-max(-30.0, min(30.0, w))))
                    for f in ("bias", *page.features[k]):
                        grad[f] = grad.get(f, 0.0) + d
                    if k:
                        e = self._edge(page.kinds[k])
                        a = whole[page.dom.parent[k]] - up[k]
                        s = [e[0], e[1] + below[k], e[2] + a, e[3] + a + below[k]]
                        top = max(s)
                        p = [exp(x - top) for x in s]
                        total = sum(p)
                        hit = 2 * y[page.dom.parent[k]] + y[k]
                        for name in ("any", page.kinds[k]):
                            row = pair.setdefault(name, [0.0] * 4)
                            for q in range(4):
                                row[q] += (q == hit) - p[q] / total
                for f, g in grad.items():
                    step(self.unary, f, None, g)
                for name, row in pair.items():
                    for q in range(4):
                        step(self.edge, name, q, row[q])
        return self.freeze()


def labelled_page(seed: int) -> str:
    """A made-up page; elements that begin content carry data-y="1", those that end it data-y="0"."""
    r = random.Random(seed)
    lorem = "river stone light under morning paper window garden winter music letter table silver harbour question answer simple between people number market".split()
    shapes = sorted(PARTS)

    def sentence(k: int) -> str:
        return (" ".join(r.choice(lorem) for _ in range(k)) + ".").capitalize()

    def prose(k: int) -> str:
        out = [sentence(r.randint(4, 18)) for _ in range(k)]
        if r.random() < 0.3:
            out.insert(r.randint(0, len(out)), f'<a href="/x">{sentence(r.randint(1, 4))}</a>')
        if r.random() < 0.3:
            t = r.choice(["b", "em", "strong", "span", "i", "code"])
            out.insert(r.randint(0, len(out)), f"<{t}>{sentence(r.randint(1, 5))}</{t}>")
        return " ".join(out)

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{" ".join(r.choice(lorem) for _ in range(r.randint(1, 4)))}</a></li>' for i in range(k)) + "</ul>"

    def some(group: str) -> str:
        w = r.choice([w for w in GROUPS[group] if len(w) > 1])
        return f"{w}-{r.choice(shapes)}" if r.random() < 0.3 else w

    def boxed(group: str, inner: str, tags: list[str]) -> str:
        t = r.choice(tags)
        key = r.choice(["class", "class", "id"])
        plain = r.random() < (0.5 if t not in ("div", "section", "p", "ul") else 0.3 if group in ("menu", "share") else 0.1 if group == "foot" else 0.0)
        return f'<{t}{"" if plain else f" {key}={chr(34)}{some(group)}{chr(34)}"} data-y="0">{inner}</{t}>'

    def named() -> str:
        """Now and then an attribute that sounds like something else than the prose that it is on."""
        if r.random() > 0.12:
            return ""
        return f' class="{r.choice([r.choice(GROUPS[r.choice(list(GROUPS))]) + "-" + r.choice(lorem), r.choice(lorem), r.choice(lorem) + "-" + r.choice(shapes)])}"'

    def junk(where: str) -> str:
        made = {
            "menu": lambda: boxed("menu", links(r.randint(2, 8)), ["nav", "div", "ul"]),
            "head": lambda: boxed("head", r.choice([f"<a href='/'>{sentence(2)}</a>", f"<h1>{sentence(3)}</h1>", f"<h1><a href='/'>{sentence(2)}</a></h1>"]) + (f"<p>{sentence(5)}</p>" if r.random() < 0.4 else ""), ["header", "div"]),
            "foot": lambda: boxed("foot", f"&copy; {sentence(r.randint(2, 9))}" + (links(3) if r.random() < 0.5 else ""), ["footer", "div"]),
            "side": lambda: boxed("side", f"<h3>{sentence(2)}</h3>" + r.choice([links(r.randint(2, 6)), f"<p>{prose(2)}</p>"]), ["aside", "div", "section"]),
            "notice": lambda: boxed("notice", f"<p>{prose(r.randint(1, 2))}</p>" if r.random() < 0.5 else prose(1), ["div", "section", "p"]),
            "ad": lambda: boxed("ad", r.choice([prose(1), f"<p>{prose(1)}</p>", f'<a href="/b">{sentence(4)}</a>']), ["div", "section", "aside", "p"]),
            "form": lambda: boxed("form", f'<label>{sentence(2)}</label><input type="text"><button>{sentence(1)}</button>' + (f"<p>{sentence(8)}</p>" if r.random() < 0.5 else ""), ["form", "div", "form"]),
            "comment": lambda: boxed("comment", f"<h3>{sentence(2)}</h3>" + "".join(f'<div class="{some("comment")}"><b>{sentence(1)}</b><p>{prose(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 4))), ["section", "div", "ul"]),
            "share": lambda: boxed("share", links(3), ["div", "ul"]),
        }
        return made[where]()

    def article(whole: bool) -> str:
        """The main text; ``whole``: not in an element of its own."""
        parts = [f"<h1>{sentence(r.randint(3, 9))}</h1>"] if r.random() < 0.6 else []
        bare = r.random() < 0.12
        for _ in range(r.randint(1, 9)):
            u = r.random()
            t = r.choice(["h2", "h3"])
            parts.append(
                f"{prose(r.randint(2, 6))}<br><br>" if bare
                else f"<p{named()}>{prose(r.randint(1, 6))}" + r.choice(["</p>", "</p>", ""]) if u < 0.7
                else f"<{t}>{sentence(4)}</{t}>" if u < 0.78
                else "<ul>" + "".join(f"<li>{prose(1)}</li>" for _ in range(3)) + "</ul>" if u < 0.84
                else f"<blockquote><p>{prose(2)}</p></blockquote>" if u < 0.88
                else f"<p><b>{sentence(6)}<br><p>{prose(2)}</p>" if u < 0.92
                else f"<table><tr><td>{sentence(2)}</td><td>{sentence(3)}</td></tr></table>" if u < 0.95
                else f"<pre>{sentence(5)}</pre>" if u < 0.97
                else f"<figure><img src='a.png'><figcaption>{sentence(6)}</figcaption></figure>"
            )
            if r.random() < 0.15:
                parts.append(junk(r.choice(["ad", "share", "notice", "side", "form"])))
        if r.random() < 0.2:
            parts.append(junk("comment"))
        inner = "".join(parts)
        if whole:
            return inner
        u = r.random()
        if u < 0.35:
            return f'<article data-y="1">{inner}</article>'
        if u < 0.48:
            return f'<main data-y="1">{inner}</main>'
        if u < 0.68:
            return f'<div class="{some("main")}" data-y="1">{inner}</div>'
        if u < 0.92:
            t = r.choice(["div", "div", "section"])
            return f'<{t}{named()} data-y="1">{inner}</{t}>'
        menu = r.choice([links(3), "<br>".join(f'<a href="/{i}">{r.choice(lorem)}</a>' for i in range(r.randint(2, 6)))])
        return f'<table><tr><td data-y="0">{menu}<td data-y="1">{inner}</table>'

    if r.random() < 0.04:  # nothing but the text
        return r.choice([prose(6), f"<p>{prose(3)}<p>{prose(3)}", f"{prose(3)}<br>{prose(2)}"])
    whole = r.random() < 0.15
    top = [junk("menu")] if r.random() < 0.8 else []
    top += [junk(k) for k in ("head", "ad", "notice", "form", "share") if r.random() < 0.4]
    r.shuffle(top)
    end = [junk(k) for k in ("side", "comment", "form", "ad", "notice", "menu") if r.random() < 0.3] + ([junk("foot")] if r.random() < 0.85 else [])
    body = "".join(top) + article(whole) + "".join(end)
    if r.random() < 0.3:
        body = f"<div>{body}</div>"
    head = f"<head><meta charset='utf-8'><title>{sentence(5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    mark = ' data-y="1"' if whole else ""
    return f"<!DOCTYPE html><html>{head}<body{mark}>{body}" + r.choice(["</body></html>", ""])


def labels(page: Page) -> list[int]:
    """Element values from data-y, which is inherited; all of a page without it is content."""
    d = page.dom
    y = [int(not any("data-y" in a for a in d.attrs))] * len(d.tag)
    for k in range(1, len(y)):
        m = re.search(r'data-y="([01])"', d.attrs[k])
        y[k] = int(m[1]) if m else y[d.parent[k]]
    return y


@lru_cache(maxsize=1)
def model(pages: int = 400) -> TreeModel:
    """The fitted weights; about five seconds on the driver."""
    made = [Page(labelled_page(k)) for k in range(pages)]
    return TreeModel().fit([(p, labels(p)) for p in made])


def extract(html: str, fitted: TreeModel) -> str:
    """The page's content, blocks in page order joined by one space."""
    if not html:
        return ""
    page = Page(html)
    d = page.dom
    odds = fitted.messages(page)[0]
    blocks: list[str] = []
    held: list[str] = []
    silent, parent, tag = page.silent, d.parent, d.tag
    block_of: list[int] = [0] * len(tag)
    for k in range(1, len(tag)):
        block_of[k] = k if tag[k] not in INLINE else block_of[parent[k]]
    last = -1
    for k, t in d.texts:
        if silent[k] or odds[k] <= 0:
            continue
        b = block_of[k]
        if b != last and held:
            blocks.append("".join(held))
            held = []
        last = b
        held.append(unescape(t))
    blocks.append("".join(held))
    return " ".join(x for x in (_SPACE.sub(" ", b).strip() for b in blocks) if x)


def main_text(pages: DataFrame, html: str = "html", fitted: TreeModel | None = None) -> DataFrame:
    """``pages`` with text and n_chars in place of its html.

    Null and empty pages, and pages without content, give the empty text and 0;
    repeated rows each keep theirs; columns named text or n_chars are replaced;
    an empty table gives an empty result. Narrow: no shuffle, one page at a time;
    the weights, of a fixed size, are trained on the driver and go with the task.
    """
    fitted = fitted or model()
    whole_texts(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    src = pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias(unused(pages.columns, "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [extract(x.as_py(), fitted) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, schema)
