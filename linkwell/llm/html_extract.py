"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

Pages are parsed leniently.  Every block element, every other element with attributes, and text
that stands directly in the page's root is a node with features: its tag and attribute tokens (as log odds
learnt in training), subtree density, links, depth, siblings, ancestors, place.  The trees give a
logit for "mostly article text".  Decoding keeps the set of nodes with the largest sum of logits
among those in which a kept node's ancestors are kept too, so an article inside a dropped menu, or a
kept paragraph under a dropped advert, cannot occur.

The trees are trained on pages made by ``training_pages``, whose texts are marked as article or not.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded
from linkwell.llm.boosting import Trees, boost

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Element names of HTML, by how they are read (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template head title desc metadata annotation annotation-xml".split())
#: Read as text, marks included.
LITERAL = frozenset(("xmp", "plaintext", "listing"))
#: Nodes even without attributes, as what they hold may stand in for something else.
STANDS_IN = frozenset("noscript iframe object canvas video audio noframes noembed svg".split())
BLOCK = frozenset("html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary center hr dialog menu hgroup search select textarea".split())
#: What an opening tag closes, if it is open inside the given boundary (fixed values).
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": ((), ())}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "select", "textarea"}
HOLDS = BLOCK - {"p"}
ROOTS = frozenset(("#root", "html", "body"))
MARK = "\ue000"


@dataclass
class Page:
    """Nodes in page order, parents first, and text runs as (node, block, text)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # last: inside a link
    controls: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def node(self, tag: str, parent: int, tokens: tuple[str, ...]) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        return len(self.tag) - 1


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    return tuple(t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall(html.unescape(m[1]))) if "=" in attributes else ()


def parse(text: str) -> Page:
    """A page of any HTML; what is open at the end is closed there."""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, and the node that holds their text
    block, links, at, n = 0, 0, 0, len(text)
    last = text.rfind(">") + 1  # what follows is text
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    holding: list[int] = []  # of open block elements but p
    newest = lambda names: max((places[x][-1] for x in names if places[x]), default=0)

    def add(run: str) -> None:
        if run and not (run.isspace() and not page.runs):
            node = stack[-1][1]
            if page.tag[node] in ROOTS and not run.isspace():
                node = page.node("#text", node, ())
            page.runs.append((node, block, run, links > 0))

    def pop(k: int) -> None:
        nonlocal links
        for t, _ in stack[k:]:
            places[t].pop()
            if t in HOLDS:
                holding.pop()
            links -= t == "a"
        del stack[k:]

    while at < n:
        m = _TAG.search(text, at, last)
        add(text[at : m.start()] if m else text[at:])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                block += 1
            # an inline element's end reaches no further than the block it stands in
            least = 0 if name in BLOCK else max(holding[-1] if holding else 0, newest(("p",)))
            if (k := newest((name,))) > least:
                pop(k)
            continue
        if name in LITERAL:
            end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            block += 1
            add(html.escape(text[at : end.start() if end else n], quote=False))
            block, at = block + 1, end.end() if end else n
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at) or (name == "head" and re.compile(r"<body[\s>]", re.I).search(text, at))
                # a head that never ends holds only its own kind of elements
                at = (end.end() if end[0][1] == "/" else end.start()) if end else (at if name == "head" else n)
            continue
        if name in ("br", "hr") or name in BLOCK:
            if name == "br":
                page.runs.append((stack[-1][1], block, " ", links > 0))
                continue
            block += 1
        if name in VOID:
            if name == "input":
                page.controls[stack[-1][1]] += 1
            continue
        closes, boundary = CLOSES.get(name, (("p",), HOLDS) if name in ENDS_P else ((), ()))
        if (k := newest(closes)) > (holding[-1] if boundary is HOLDS and holding else newest(boundary)):
            pop(k)
        if name in CLOSES and name in ENDS_P and (k := newest(("p",))) > (holding[-1] if holding else 0):
            pop(k)
        holder, tokens = stack[-1][1], attribute_tokens(attributes)
        if name in BLOCK or name in STANDS_IN or tokens:
            holder = page.node(name, holder, tokens)
        if name in ("input", "button", "select", "textarea", "option"):
            page.controls[holder] += 1
        links += name == "a"
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            places[name].append(len(stack))
            if name in HOLDS:
                holding.append(len(stack))
            stack.append((name, holder))
    return page


FEATURES = 25


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row for each node.  ``odds``: log odds of "tag" and ".token"."""
    n = len(page.tag)
    parent = page.parent
    own, linked, stops, first = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    seen = 0.0
    starts = [-1.0] * n
    for node, _, run, link in page.runs:
        size = len(run.strip())
        if starts[node] < 0:
            starts[node] = seen
        own[node] += size
        linked[node] += size * link
        stops[node] += sum(map(run.count, ".,;!?"))
        seen += size
    depth, children = [0] * n, [[] for _ in range(n)]
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        children[parent[i]].append(i)
    text, tags, paragraphs, items, controls = own[:], [1] * n, [0] * n, [0] * n, [page.controls.get(i, 0) for i in range(n)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        tag = page.tag[i]
        paragraphs[i] += tag == "p"
        items[i] += tag == "li"
        text[p] += text[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
        controls[p] += controls[i]
        if starts[p] < 0 or 0 <= starts[i] < starts[p]:
            starts[p] = starts[i]
    low, high, low_tag = [0.0] * n, [0.0] * n, [0.0] * n
    place, kin, same = [0] * n, [1] * n, [1.0] * n
    mean = [0.0] * n
    for i in range(n):
        group = children[i]
        if group:
            number = defaultdict(int)
            for c in group:
                number[page.tag[c]] += 1
            average = sum(text[c] for c in group) / len(group)
            for k, c in enumerate(group):
                place[c], kin[c], same[c], mean[c] = k, len(group), number[page.tag[c]] / len(group), average
    out = np.zeros((n, FEATURES))
    whole = max(seen, 1.0)
    for i in range(n):
        tag = odds.get(page.tag[i], 0.0)
        mine = [odds.get("." + t, 0.0) for t in page.tokens[i]]
        worst, top = min(mine, default=0.0), max(mine, default=0.0)
        p = parent[i]
        if p >= 0:
            low_up, high_up, low_tag_up = low[p], high[p], low_tag[p]
        else:
            low_up = high_up = low_tag_up = 0.0
        low[i], high[i], low_tag[i] = min(low_up, worst), max(high_up, top, tag), min(low_tag_up, tag)
        size = text[i]
        out[i] = (
            tag, worst, top, sum(mine) / max(len(mine), 1), len(mine), depth[i], place[i], kin[i], same[i], math.log1p(size), size / tags[i],
            linked[i] / max(size, 1), own[i] / max(size, 1), math.log1p(paragraphs[i]), stops[i] / max(size, 1), max(starts[i], 0) / whole, size / whole,
            odds.get(page.tag[p], 0.0) if p >= 0 else 0, low_up, high_up, low_tag_up, math.log1p(mean[i]), math.log1p(items[i]), math.log1p(controls[i]), size / max(mean[i], 1))
    return out


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """The best set of nodes that holds every kept node's ancestors.  The roots cost nothing."""
    n = len(page.tag)
    gain = [0.0 if page.tag[i] in ROOTS else float(logits[i]) for i in range(n)]
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and (gain[i] > 0 or page.tag[i] in ROOTS)
    return keep


def render(page: Page, keep: list[bool]) -> str:
    """Kept blocks in page order, one line each: white space as one space, references decoded, each within its run of text."""
    lines, now, parts = [], -1, []
    for node, block, run, _ in [*page.runs, (0, -2, "", False)]:
        if block != now:
            if line := " ".join("".join(parts).split()):
                lines.append(line)
            now, parts = block, []
        if keep[node]:
            parts.append(html.unescape(run))
    return "\n".join(lines)


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]
    trees: Trees

    def extract(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        if not parsed:
            return []
        rows = [features(p, self.odds) for p in parsed]
        logits = np.clip(self.trees.logits(np.concatenate(rows)), -8, 8)
        out, at = [], 0
        for page, row in zip(parsed, rows, strict=True):
            out.append(render(page, decode(page, logits[at : at + len(row)])))
            at += len(row)
        return out


def training_pages(number: int, seed: int = 11) -> Iterator[str]:
    """Made-up pages of many layouts.  Article text carries a private-use mark at its front."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiounrstlhd") for _ in range(r.randint(2, 9)))

    def sentence(a: int = 3, b: int = 18) -> str:
        w = [word() for _ in range(r.randint(a, b))]
        return " ".join(w).capitalize() + r.choice((".", ".", ".", "!", "?", ", " + word() + "."))

    def words(a: int, b: int) -> str:
        return " ".join(word().capitalize() for _ in range(r.randint(a, b)))

    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'

    def attr(names: str) -> str:
        name = r.choice(names.split())
        if r.random() < 0.3:
            name = r.choice((f"{name}-{word()}", f"{word()}-{name}", f"{name} {word()}"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def maybe(names: str, p: float = 0.7) -> str:
        return attr(names) if r.random() < p else r.choice(("", "", f' class="{word()}"'))

    def menu() -> str:
        items = [link() for _ in range(r.randint(3, 9))]
        kind = r.random()
        inner = "<ul>" + "".join(f"<li>{x}</li>" if r.random() < 0.8 else f"<li>{x}" for x in items) + "</ul>" if kind < 0.75 else " | ".join(items)
        return r.choice((f"<nav{maybe('menu nav main-nav', 0.3)}>{inner}</nav>", f"<div{attr('menu nav navigation navbar topnav breadcrumb breadcrumbs')}>{inner}</div>", f"<ul{attr('menu nav tabs pagination pager')}>" + "".join(f"<li>{x}" for x in items) + "</ul>"))

    def header() -> str:
        parts = [r.choice((link(), f"<h1>{words(1, 3)}</h1>", f"<p>{sentence(2, 6)}</p>", f'<img src="/x.png" alt="x">{words(1, 2)}')), menu() if r.random() < 0.6 else ""]
        return r.choice(("<header%s>%s</header>" % (maybe("site-header masthead", 0.4), "".join(parts)), "<div%s>%s</div>" % (attr("header masthead banner top logo"), "".join(parts))))

    def footer() -> str:
        parts = [f"&copy; {word()}.example &middot; {sentence()}", link(), f"<p>{sentence()}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>"]
        inner = "".join(r.sample(parts, r.randint(1, 3)))
        return r.choice((f"<footer{maybe('site-footer', 0.2)}>{inner}</footer>", f"<div{attr('footer bottom copyright legal colophon')}>{inner}</div>"))

    def side() -> str:
        parts = [f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link(2, 6)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{sentence()}</p>", f"<div>{sentence()} {link()}</div>"]
        inner = "".join(r.sample(parts, r.randint(1, 3)))
        return r.choice((f"<aside{maybe('sidebar', 0.3)}>{inner}</aside>", f"<div{attr('sidebar side related widget recommended trending popular more tags')}>{inner}</div>", f"<section{attr('related sidebar widget promo')}>{inner}</section>"))

    def advert() -> str:
        inner = " ".join(sentence() for _ in range(r.randint(1, 4)))
        inner = r.choice((inner, f"<p>{inner}</p>", f'<a href="http://{word()}.example">{inner}</a>'))
        return r.choice(("<!-- ad -->", "")) + f"<{(t := r.choice(('div', 'div', 'div', 'section', 'p', 'span', 'ins')))}{attr('ad ads advert advertisement sponsored sponsor promo banner adsense')}>{inner}</{t}>"

    def notice() -> str:
        inner = " ".join(sentence() for _ in range(r.randint(1, 3)))
        return f"<{(t := r.choice(('div', 'div', 'section', 'p', 'dialog')))}{attr('cookie cookies consent notice gdpr alert popup modal newsletter subscribe signup paywall banner disclaimer')}>{r.choice((inner, f'<p>{inner}</p>'))}{r.choice(('', '<button>Ok</button>', link()))}</{t}>"

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=q>" * r.randint(1, 3) + f"<button>{words(1, 2)}</button>"
        return r.choice((f"<form{maybe('search login newsletter', 0.4)}>{r.choice(('', f'<p>{sentence()}</p>'))}{inner}</form>", f"<div{attr('search login subscribe form')}><form>{inner}</form></div>"))

    def comments() -> str:
        one = lambda: f"<{(t := r.choice(('div', 'li', 'article', 'p')))}{maybe('comment reply', 0.8)}>{r.choice(('', f'<b>{words(1, 2)}</b> ', f'<span class=author>{words(1, 2)}</span>'))}" + r.choice(("{}", "<p>{}</p>")).format(" ".join(sentence() for _ in range(r.randint(1, 5)))) + f"</{t}>"
        inner = r.choice(("", f"<h2>{words(1, 2)}</h2>", f"<h3>{r.randint(2, 90)} {words(1, 1)}</h3>")) + "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(('div', 'section', 'ul', 'aside')))}{attr('comments comment-list replies discussion respond disqus')}>{inner}</{t}>"

    def share() -> str:
        return f"<div{attr('share social sharing tools byline meta author date tags')}>{r.choice((' '.join(link() for _ in range(3)), words(2, 5)))}</div>"

    def stand_in() -> str:
        t = r.choice(("video", "audio", "object", "iframe", "canvas", "noframes", "noscript", "noscript"))
        return f"<{t}>" + r.choice(("{}", "<p>{}</p>")).format(sentence(3, 9) + r.choice(("", link()))) + f"</{t}>"

    def paragraph() -> str:
        body = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 9))))
        if r.random() < 0.08:
            body = words(1, 2) + "."
        if r.random() < 0.15:
            body = body.replace(" ", f" <{(t := r.choice(('b', 'i', 'em', 'a href=/x', 'strong', 'span')))}>", 1) + f"</{t.split()[0]}>"
        if r.random() < 0.05:
            body += f" <math><mi>{word()[0]}</mi> = <mn>{r.randint(2, 99)}</mn></math> {sentence()}"
        if r.random() < 0.05:
            body += f" <noscript>{sentence()}</noscript> {sentence()}"
        kind = r.random()
        if kind < 0.72:
            return f"<p>{MARK}{body}</p>"
        if kind < 0.8:
            return f"<p>{MARK}{body}"
        if kind < 0.92:
            return f"<p><b>{MARK}{body}<br>"
        return f"<div>{MARK}{body}</div>"

    def article() -> str:
        parts = [f"<h1>{MARK}{words(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9, 14))):
            parts.append(paragraph())
            k = r.random()
            if k < 0.08:
                parts.append(f"<h{(h := r.randint(2, 4))}>{MARK}{words(1, 7)}</h{h}>")
            elif k < 0.14:
                parts.append(f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{MARK}{r.choice((sentence(), words(1, 5)))}" + r.choice(("</li>", "")) for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.17:
                parts.append(f"<blockquote>{r.choice(('', '<p>'))}{MARK}{sentence()}</blockquote>")
            elif k < 0.19:
                parts.append(r.choice((f"<pre>{MARK}{sentence()}</pre>", f"<xmp>{MARK}{sentence()}</xmp>", f"<noscript>{MARK}{sentence()}</noscript>")))
            elif k < 0.22:
                parts.append(f"<figure><img src=x.png><figcaption>{MARK}{sentence()}</figcaption></figure>")
            elif k < 0.25:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{words(1, 3)}<td>{MARK}{words(1, 3)}</tr>" for _ in range(3)) + "</table>")
            elif k < 0.33:
                parts.append(r.choice((advert, share, side, notice, form, stand_in))())
        if not parts:
            parts = [paragraph()]
        inner = "".join(parts) + (comments() if r.random() < 0.12 else "") + (share() if r.random() < 0.1 else "")
        k = r.random()
        if k < 0.5:
            return f"<article{maybe('post entry story', 0.3)}>{inner}</article>"
        if k < 0.6:
            return f"<main{maybe('main content', 0.3)}>{inner}</main>"
        if k < 0.85:
            return f"<div{attr('content main article post entry story body text article-body post-content entry-content')}>{inner}</div>"
        if k < 0.95:
            return f"<div{maybe('', 0)}>{inner}</div>" if len(parts) > 3 else f"<section{attr('content article story')}>{inner}</section>"
        return f"{MARK}{sentence()}<br>{sentence()}" + inner

    for _ in range(number):
        before = [f() for f in r.sample((menu, header, advert, notice, form, side, stand_in), r.randint(0, 4))]
        after = [f() for f in r.sample((comments, side, advert, notice, form, menu, share), r.randint(0, 3))] + ([footer()] if r.random() < 0.75 else [])
        main = article()
        if r.random() < 0.3:
            main = f"<div{maybe('wrapper container page layout row', 0.6)}>{main}{side() if r.random() < 0.4 else ''}</div>"
        if r.random() < 0.1:
            main = f"<table><tr><td>{menu()}<td>{main}</table>"
        if r.random() < 0.35:
            before.insert(r.randint(0, len(before)), f"<noscript>{sentence(3, 12)}</noscript>")
        inner = "".join(before) + main + "".join(after)
        if r.random() < 0.2:
            inner = f"<div{maybe('wrapper container page site', 0.6)}>{inner}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{inner}" + r.choice(("</body></html>", ""))


@lru_cache(maxsize=2)
def fit(pages: int = 700, seed: int = 11) -> Model:
    """Train on made-up pages: half give the log odds of tags and tokens, all give the trees."""
    parsed = []
    for text in training_pages(pages, seed):
        page = parse(text)
        article, whole = [0.0] * len(page.tag), [0.0] * len(page.tag)
        marked = False
        for k, (node, block, run, link) in enumerate(page.runs):
            size = len(run.strip())
            if MARK in run:
                marked, run = True, run.replace(MARK, "")
                last = block
            elif marked and block != last:
                marked = False
            page.runs[k] = (node, block, run, link)
            whole[node] += size
            article[node] += size * marked
        for i in range(len(page.tag) - 1, 0, -1):
            whole[page.parent[i]] += whole[i]
            article[page.parent[i]] += article[i]
        parsed.append((page, [a > 0.5 * w for a, w in zip(article, whole, strict=True)], whole))
    yes, all_ = defaultdict(float), defaultdict(float)
    for page, label, whole in parsed[::2]:
        for i in range(1, len(page.tag)):
            if whole[i]:
                for t in {page.tag[i], *("." + t for t in page.tokens[i])}:
                    all_[t] += 1
                    yes[t] += label[i]
    odds = {t: math.log((yes[t] + 1) / (all_[t] - yes[t] + 1)) for t in all_ if all_[t] >= 4}
    rows, labels = [], []
    for page, label, whole in parsed:
        x = features(page, odds)
        use = [i for i in range(1, len(page.tag)) if whole[i] and page.tag[i] not in ROOTS]
        rows.append(x[use])
        labels += [label[i] for i in use]
    return Model(odds, boost(np.concatenate(rows), np.array(labels, np.float64)))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for every input row: id, url, text, n_chars.

    Null and empty pages give empty text.  Pages of any length are read whole.  Repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    model = model or fit()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = model.extract(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return bounded(rows).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
