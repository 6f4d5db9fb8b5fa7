"""Main text of web pages: boosted trees over DOM nodes, decoded hierarchically.

Each element gets features of its tag, attribute tokens, depth, subtree density and siblings,
and the trees give its log-odds of lying in the article. A page is then labelled as a whole:
on each path from the root, nodes are before the article, in it, or cut out of it again, in
this order. The best such labelling is found bottom-up, so no node is kept inside one that
was cut out, and no ancestor contradicts its descendants.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.boosting import Boosted, fit_boosted
from lapwing.llm.common import hashed_sample, runs, table

#: Pages that the fit uses, and layouts that each is laid out in besides its own.
SAMPLE, LAYOUTS = 120, 8
#: Pages are read together up to so many bytes.
PAGE_BYTES = 2 << 20
#: Cost of entering the article, and of cutting a part out of it, in log-odds.
ENTER, LEAVE = 4.0, 2.0

#: A tag up to its end: quoted values only where the standard has them, right after "=". Nothing is tried twice.
_TAG_END = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_TAG_START = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

#: Fixed values of HTML: elements without content, raw text, blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea select title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html div section article aside nav td th".split())

TAGS = ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", "nav", "header", "footer", "aside", "form fieldset", "button input label option legend", "table tbody tr td th", "blockquote pre figure figcaption", "b i em strong span code mark small sub sup u q cite abbr time", "html body head", "script style template noscript iframe svg textarea select title object dialog")
_TAG = {t: i for i, group in enumerate(TAGS) for t in group.split()}
#: Attribute tokens that are features, by kind of page part.
TOKENS = (
    "article post entry story body text content main page prose",
    "nav menu navbar breadcrumb breadcrumbs pager pagination tabs toc",
    "header head banner masthead topbar logo branding",
    "footer foot copyright colophon legal bottom",
    "sidebar side aside widget widgets rail related recommended more",
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion dfp outbrain taboola",
    "cookie cookies consent gdpr notice notices alert popup modal overlay warning message",
    "comment comments reply replies respond discussion disqus reader readers responses thread",
    "form search subscribe newsletter signup login share social sharing follow",
    "hidden meta tags tag byline author date skip",
)
_KIND = {t: i for i, group in enumerate(TOKENS) for t in group.split()}


class Page:
    """Elements of a page in document order, and its text as (element, block, text) runs."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.runs = ["#root"], [-1], [0], []
        self.child_of = [0]
        self.children = [0]
        self.opened: list[tuple[str, str]] = []  # start tags with their attributes
        self._stack, self._places, self._scopes = [0], {}, [0]
        block, at, text_from, broken, unclosed = 0, 0, 0, False, set()
        last = source.rfind(">")
        while (at := source.find("<", at)) >= 0:
            m = None
            if at > last and not source.startswith("<!--", at):
                break
            if source.startswith("<!--", at):
                end = source.find("-->", at + 2)
                past = end + 3 if end >= 0 else len(source)
            elif source[at + 1] in "!?":
                past = source.index(">", at) + 1
            else:
                m = None if broken else _TAG_END.match(source, at + 1)
                if not m and (source[at + 1].isalpha() or source[at + 1] == "/"):
                    m = _TAG_START.match(source, at + 1)
                    broken |= bool(m)  # quotes stay open to the end: from here on they mean nothing
                if not m:
                    at += 1
                    continue
                past = m.end()
            if at > text_from:
                self.runs.append((self._stack[-1], block, source[text_from:at]))
            at = text_from = past
            if not m:
                continue
            tag = m[2].lower()
            if m[1]:
                block += tag in BLOCK
                if self._places.get(tag):
                    self._pop(self._places[tag][-1])
                continue
            self._close(tag)
            block += tag in BLOCK
            self.opened.append((tag, m[3]))
            node = self._add(self._stack[-1], tag, m[3])
            if tag == "br":
                self.runs.append((self._stack[-1], block, " "))
            if tag in RAW and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if not end:
                    unclosed.add(tag)
                if end or tag in ("script", "style"):
                    at = text_from = end.end() if end else len(source)
                    continue
            if tag not in VOID and not m[3].endswith("/"):
                self._places.setdefault(tag, []).append(len(self._stack))
                if tag in SCOPES:
                    self._scopes.append(len(self._stack))
                self._stack.append(node)
        if text_from < len(source):
            self.runs.append((self._stack[-1], block, source[text_from:]))

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            self._places[self.tag[self._stack.pop()]].pop()
        while self._scopes[-1] >= place:
            self._scopes.pop()

    def _close(self, tag: str) -> None:
        """What a start tag ends: a paragraph before a block, an item before the next."""
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while ends:
            place = max((self._places[e][-1] for e in ends if self._places.get(e)), default=0)
            if not place or place < self._scopes[-1]:
                return
            self._pop(place)
            if tag not in CLOSES:
                return

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        kinds = 0
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "aria" in attributes):
            for name, *values in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
                    for token in _SPLIT.split("".join(values)):
                        if (k := _KIND.get(token.lower())) is not None:
                            kinds |= 1 << k
        self.tag.append(tag)
        self.parent.append(parent)
        self.kinds.append(kinds)
        self.children.append(0)
        self.child_of.append(self.children[parent])
        self.children[parent] += 1
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, links, stops, tags, paragraphs, depth = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        for node, _, text in self.runs:
            own[node] += len(text) - text.count(" ") if text.strip() else 0
            stops[node] += text.count(".") + text.count(",")
        total = own.copy()
        above = [0] * n  # kinds of parts that stand above
        group_above = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.kinds[p]
            group_above[i] = group_above[p] | 1 << _TAG.get(self.tag[p], len(TAGS))
        for i in range(n - 1, 0, -1):
            p, tag = self.parent[i], self.tag[i]
            links[i] = total[i] if tag == "a" else links[i]
            paragraphs[i] += tag == "p"
            for v in (total, links, stops, tags, paragraphs):
                v[p] += v[i]
        parent = self.parent
        before = [0] * n
        last: dict[int, int] = {}
        for i in range(1, n):
            before[i] = total[last[parent[i]]] if parent[i] in last else 0
            last[parent[i]] = i
        c = lambda v: np.array(v[1:], dtype=np.float32)
        up = np.array(parent[1:], dtype=np.int64)
        total_, links_, stops_, tags_ = c(total), c(links), c(stops), c(tags)
        group = np.array([_TAG.get(t, len(TAGS)) for t in self.tag[1:]])
        kinds, kinds_above, groups_above = (np.array(v[1:]) for v in (self.kinds, above, group_above))
        bits = lambda v, k: (v[:, None] >> np.arange(k) & 1).astype(np.float32)
        page = max(total[0], 1)
        columns = [
            np.log1p(total_), np.log1p(c(own)), links_ / np.maximum(total_, 1), stops_ / np.maximum(total_, 1), total_ / tags_, np.log1p(tags_), total_ / page,
            c(depth), c(self.child_of), c(self.children), np.array(self.children, dtype=np.float32)[up], total_ / np.maximum(np.array(total, dtype=np.float32)[up], 1), np.log1p(c(before)), c(paragraphs), np.arange(1, n, dtype=np.float32) / n,
        ]
        return np.hstack([np.stack(columns, axis=1), (group[:, None] == np.arange(len(TAGS))).astype(np.float32), bits(kinds, len(TOKENS)), bits(kinds_above, len(TOKENS)), bits(groups_above, len(TAGS))])

    def decode(self, logit: np.ndarray) -> list[bool]:
        """The elements in the article, by the best labelling of the tree as before, in or after."""
        n = len(self.tag)
        own = [0] * n
        for node, _, text in self.runs:
            own[node] += len(text)
        score = [0.0, *(logit * (0.5 + np.log1p(np.array(own[1:], dtype=float)))).tolist()]
        # best totals of a subtree, its root being before, in or after the article; a node in it scores
        before, inside = [0.0] * n, score.copy()
        enter, leave = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            enter[i], leave[i] = inside[i] - ENTER > before[i], -LEAVE > inside[i]
            before[p] += max(before[i], inside[i] - ENTER)
            inside[p] += max(inside[i], -LEAVE)
        state = [0] * n
        for i in range(1, n):
            s = state[self.parent[i]]
            state[i] = (1 if enter[i] else 0) if s == 0 else (2 if leave[i] else 1) if s == 1 else 2
        return [s == 1 for s in state]

    def text(self, kept: list[bool]) -> str:
        """Blocks in page order, white space in a block made one space."""
        out, now, parts = [], -1, []
        for node, block, text in [*self.runs, (0, -2, "")]:
            if block != now:
                if line := " ".join("".join(parts).split()):
                    out.append(line)
                now, parts = block, []
            if kept[node]:
                parts.append(html.unescape(text))
        return "\n".join(out)


def _boilerplate(rng: random.Random, text) -> list[str]:
    """Parts around an article, filled with other pages' words."""
    words = lambda k: " ".join(text().split()[:k])
    items = lambda k: "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(k))
    paras = lambda k: "".join(f"<p>{words(rng.randint(5, 60))}</p>" for _ in range(k))
    box = lambda names, inner: f'<{(t := rng.choice(["div", "div", "section", "aside"]))} {rng.choice(["class", "id"])}="{rng.choice(names)}">{inner}</{t}>'
    return [
        rng.choice([f"<nav><ul>{items(5)}</ul></nav>", box(["menu", "navbar", "main-nav", "breadcrumbs"], f"<ul>{items(6)}</ul>")]),
        rng.choice([f"<header><p>{words(6)}</p></header>", f"<header><a href='/'>{words(2)}</a>{paras(1)}</header>", box(["site-header", "banner", "masthead", "header"], f"<p>{words(8)}</p>")]),
        rng.choice([f"<footer>&copy; {words(8)}</footer>", f"<footer>{paras(2)}<ul>{items(3)}</ul></footer>", box(["footer", "site-footer", "copyright"], paras(1))]),
        rng.choice([f"<aside>{paras(2)}</aside>", f"<aside><h3>{words(3)}</h3><ul>{items(4)}</ul></aside>", box(["sidebar", "widget", "related", "side-column"], f"<h3>{words(3)}</h3>{paras(2)}<ul>{items(3)}</ul>")]),
        box(["ad", "ads", "advert", "sponsored", "promo-box", "advertisement"], rng.choice([words(12), paras(1), f"<a href='/x'>{words(5)}</a>"])),
        box(["cookie-notice", "notice", "alert", "consent", "cookie-banner", "popup"], rng.choice([f"<p>{words(20)}</p><button>{words(1)}</button>", words(15)])),
        rng.choice([box(["comments", "comment-list", "reader-comments", "discussion"], "".join(f'<div class="comment"><p>{words(3)}</p>{paras(rng.randint(1, 2))}</div>' for _ in range(3))), f'<section id="comments"><h2>{words(2)}</h2><ul>' + "".join(f"<li>{paras(1)}</li>" for _ in range(3)) + "</ul></section>"]),
        rng.choice([f'<form action="/s"><label>{words(3)}</label><input name="q"><button>{words(1)}</button></form>', box(["newsletter", "subscribe", "search", "share"], f"<form>{paras(1)}<input><button>{words(2)}</button></form>")]),
    ]


def _piece(rng: random.Random, text: str) -> str:
    """Article words in one of the elements that articles hold: lists, tables, definitions, quotations, figures and others besides paragraphs."""
    kind = rng.choices(("p", "h", "list", "table", "dl", "quote", "pre", "figure", "div", "wrapped"), (60, 8, 9, 6, 3, 4, 3, 4, 3, 2))[0]
    words = text.split()
    cuts = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randint(1, 7)))) if len(words) > 1 else []
    parts = [" ".join(words[i:j]) for i, j in zip([0, *cuts], [*cuts, len(words)])]
    if kind == "list":
        tag, inner = rng.choice(["ul", "ol"]), rng.choice(["{}", "{}", "<p>{}</p>", "<b>{}</b>", "<a href='/x'>{}</a>"])
        return f"<{tag}>" + "".join(f"<li>{inner.format(x) if rng.random() < 0.6 else x}</li>" for x in parts) + f"</{tag}>"
    if kind == "table":
        row = lambda x, tag: f"<tr><{tag}>{x}</{tag}></tr>"
        rows = "".join(row(f"</td><td>".join(x.split(" ", 1)) if rng.random() < 0.7 else x, "td") for x in parts)
        return f"<table>{rng.choice(['', '<caption>' + words[0] + '</caption>'])}{rng.choice(['', '<thead><tr><th>' + words[0] + '</th><th>' + words[-1] + '</th></tr></thead>'])}<tbody>{rows}</tbody></table>"
    if kind == "dl":
        return "<dl>" + "".join(f"<{t}>{x}</{t}>" for x, t in zip(parts, ("dt", "dd") * 8)) + "</dl>"
    if kind == "figure":
        return f"<figure><img src='/i.jpg' alt=''><figcaption>{text}</figcaption></figure>"
    if kind == "quote":
        return rng.choice([f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>"])
    if kind == "pre":
        return rng.choice([f"<pre>{text}</pre>", f"<pre><code>{text}</code></pre>"])
    if kind == "wrapped":
        return f"<section><h2>{parts[0]}</h2>" + "".join(f"<p>{x}</p>" for x in parts[1:] or parts) + "</section>"
    return f"<h{rng.randint(2, 4)}>{' '.join(words[:9])}</h{0}>".replace("</h0>", "</h2>") if kind == "h" else f"<div>{text}</div>" if kind == "div" else f"<p>{rng.choice(['', '', '<b>' + words[0] + '</b> ', '<a href=/y>' + words[0] + '</a> '])}{text}</p>"


def _out(part: str) -> str:
    """A part marked as not of the article."""
    return re.sub(r"^<([a-z0-9]+)", r"<\1 data-out", part, count=1)


def layout(rng: random.Random, title: str, paragraphs: list[str], text) -> str:
    """A page with the article in a root, or in none but the body, and the usual parts around and inside it; what is of the article is known by where it came from."""
    parts = [_out(p) for p in _boilerplate(rng, text)]
    rng.shuffle(parts)
    parts = parts[: rng.randint(2, len(parts))]
    inside = [p for p in parts[:2] if rng.random() < 0.35]
    outer = [p for p in parts if p not in inside]
    split = rng.randint(0, len(outer))
    head = rng.choice(["<h1>{}</h1>"] * 4 + ["<header><h1>{}</h1></header>", "<header><h1>{}</h1><p>{}</p></header>", "<h2>{}</h2>", "<div><h1>{}</h1></div>"]).replace("{}", title, 1).replace("{}", " ".join(title.split()[:5]))
    body = [head, *[_piece(rng, p) for p in paragraphs if p.split()]]
    if rng.random() < 0.15:
        body.append(rng.choice([f"<hr><small>{title}</small>", f"<p><small>{title}</small></p>", f"<p><em>{title}</em></p>"]))
    for p in inside:
        body.insert(rng.randint(1, len(body)), p)
    tag, mark = rng.choice([("article", ""), ("article", ""), ("main", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="article-body"'), ("div", 'class="post"'), ("section", 'class="entry-content"'), ("div", 'id="main"'), ("div", 'class="story"'), ("td", ""), ("div", ""), ("section", ""), *[("", "")] * 5])
    if tag:
        core = f'<{tag} {mark} data-core>{"".join(body)}</{tag}>'
    else:
        core = "".join(p if "data-out" in p[:40] else re.sub(r"<([a-z0-9]+)", r"<\1 data-core", p, count=1) for p in body).replace("<hr data-core><small>", "<hr data-core><small data-core>")
    for _ in range(rng.randint(0, 2)):
        core = f"<div{rng.choice(['', ' class=\"wrap\"', ' id=\"page\"', ' class=\"container\"'])}>{core}</div>"
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(outer[:split])}{core}{''.join(outer[split:])}</body></html>"


#: Elements that are no article's text wherever they stand; a header inside an article is its own.
_CUT_OUT = frozenset("nav footer aside form script style noscript template iframe button".split())


def _labels(page: Page, source: str) -> np.ndarray | None:
    """1 for elements in the article: those marked as its cores and what is in them, but for what is marked as out; else the only <article> but for parts by name."""
    y = np.zeros(len(page.tag), dtype=np.int8)
    if "data-core" in source:
        for i, (_, attributes) in enumerate(page.opened, 1):
            y[i] = ("data-core" in attributes or y[page.parent[i]]) and "data-out" not in attributes
        return y[1:]
    if page.tag.count("article") != 1:
        return None
    core = page.tag.index("article")
    y[core] = 1
    for i in range(core + 1, len(page.tag)):
        out = page.tag[i] in _CUT_OUT or page.kinds[i] & ~(1 | 1 << 9)
        y[i] = y[page.parent[i]] and not out
    return y[1:]


def training_rows(sources: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[str]:
    """The pages whose text an <article> marks, and the same paragraphs, whole, in other layouts, whose labels are known from how they were made."""
    rng, texts, out = random.Random(seed), [], []
    for source in sources:
        page = Page(source)
        y = _labels(page, source)
        if y is not None and y.any():
            out.append(source)
            lines = page.text([False, *y.astype(bool).tolist()]).split("\n")
            texts.append([html.escape(x) for x in lines if x] or ["Text."])
    pool = [x for t in texts for x in t] or ["Some words to fill a page with, more or less."]
    for t in texts or [pool * 3]:
        for _ in range(layouts):
            paragraphs = t[1:] or t
            start = rng.randrange(len(paragraphs)) if rng.random() < 0.5 else 0
            out.append(layout(rng, t[0], paragraphs[start:] if rng.random() < 0.5 else paragraphs[: start + 1], lambda: rng.choice(pool)))
    return out


def fit(pages: DataFrame, html_col: str = "html", most: int = SAMPLE, layouts: int = LAYOUTS) -> Boosted:
    """Fits the trees on at most ``most`` different pages, chosen by hash, and on ``layouts`` layouts of each one's paragraphs."""
    return fit_pages(training_rows(hashed_sample(pages, html_col, most), layouts))


def fit_pages(sources: list[str]) -> Boosted:
    xs, ys = [np.zeros((0, Page("<p>").features().shape[1]), dtype=np.float32)], [np.zeros(0)]
    for source in sources:
        page = Page(source)
        y = _labels(page, source)
        if y is not None and len(y):
            xs.append(page.features())
            ys.append(y)
    x, y = np.vstack(xs), np.concatenate(ys).astype(float)
    weight = 0.2 + x[:, 1]  # by own text
    return fit_boosted(x, y, weight, trees=60, depth=5, rate=0.2)


def extract(pages: DataFrame, model: Boosted, html_col: str = "html", together: int = 100) -> DataFrame:
    """``pages`` without the html, with text and n_chars. Null or empty html, and pages with no article, give empty text.

    Whole pages are read. Repeated rows and extra columns pass through; text and n_chars are replaced.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def read(batches):
        for batch in batches:
            for at, here in runs(batch.column(len(names)), PAGE_BYTES, together):
                part = batch.slice(at, len(here))
                found = [Page(x or "") for x in part.column(len(names)).to_pylist()]
                x = [p.features() if len(p.tag) > 1 else None for p in found]
                full = [f for f in x if f is not None]
                logits = iter(np.split(model.logit(np.vstack(full)), np.cumsum([len(f) for f in full])[:-1]) if full else [])
                texts = [p.text(p.decode(next(logits))) if f is not None else "" for p, f in zip(found, x, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    rows = pages.select(*names, html_col)
    fields = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names], "text string", "n_chars long"])
    return rows.mapInArrow(read, fields)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), fit(pages))
