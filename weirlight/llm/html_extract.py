"""Main text of web pages, by gradient-boosted trees over the nodes of the page's tree.

A tolerant parser makes a tree of block elements; runs of inline content are its leaves. Each node has features of its
tag, its attribute tokens, its depth, its subtree (text density, links, punctuation), its siblings and its ancestors.
Boosted trees, trained here on generated pages whose main text is known, give each node the chance that its subtree
holds main text. Decoding picks the likeliest labels among those in which no node holds main text whose ancestor holds
none, by a pass over the tree from its leaves. Kept leaves are the blocks of the result, in page order.

Character references are decoded, white space inside a block (a line break is one) becomes one space, blocks are
trimmed and joined by two \\n. Nothing is cut or capped, and extraction is one pass over the pages without a shuffle.

Defined cases: null and empty html, and pages without main text, give an empty text; null page_id and url stay null;
repeated rows are worked through as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.common import table

PAGES, TREES, DEPTH, RATE, BINS = 900, 60, 4, 0.2, 32
SCHEMA = "page_id long, url string, text string, n_chars long"

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
MARK = re.compile(r"""=\s*(["'])|[<>]""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What is inside of these isn't shown, or is no text of the page. Formulas (math) and what object falls back on count as inline content.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "xmp", "noembed", "noframes", "select", "button", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html head legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
STOPS = ("ul", "ol", "table", "dl", "div", "article", "section", "menu")
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KINDS = ["leaf", "p", "h", "li", "list", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "root"]
KIND = {t: k for k, ts in {"p": "p", "h": "h1 h2 h3 h4 h5 h6", "li": "li dt dd", "list": "ul ol dl menu dir", "div": "div center address details summary dialog", "article": "article", "main": "main", "section": "section", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend", "table": "table tbody td tfoot th thead tr", "quote": "blockquote pre", "figure": "figure figcaption", "root": "html body head"}.items() for t in ts.split()}
GROUPS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs skip links", "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola", "comment": "comment comments reply replies respond disqus discussion feedback reviews thread",
    "foot": "footer foot copyright legal colophon bottom", "head": "header masthead topbar top branding logo hero", "side": "sidebar side aside widget widgets related recommended popular trending more rail secondary",
    "notice": "notice cookie cookies consent gdpr popup modal alert warning subscribe newsletter signup login overlay paywall toast", "share": "share sharing social follow tags meta byline author date timestamp", "form": "form search contact input", "content": "content article post story main body entry text page blog news prose hentry articlebody",
}
BIT = {w: 1 << i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
N_GROUPS = len(GROUPS)


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, lower-case name ("" for comments and declarations), whether it closes, and attributes of each tag, in one pass.

    A quote counts only after "=", and only if it is closed; a tag ends at the next > or before the next < outside of quotes.
    A < that no name follows, or after which no < or > comes, is text.
    """
    at, unclosed, last = 0, set(), max(html.rfind(">"), html.rfind("<"))
    while (i := html.find("<", at)) >= 0 and i < last:
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = len(html) if end < 0 else end + 3
            yield i, at, "", False, ""
            continue
        if html[i + 1] in "!?":
            end = html.find(">", i)
            if end < 0:
                return
            at = end + 1
            yield i, at, "", False, ""
            continue
        closing = html[i + 1] == "/"
        m = NAME.match(html, i + 1 + closing)
        if not m:
            at = i + 1
            continue
        k = m.end()
        while found := MARK.search(html, k):
            quote = found[1]
            if not quote:
                break
            k = found.end()
            if quote not in unclosed:
                end = html.find(quote, k)
                if end < 0:
                    unclosed.add(quote)
                else:
                    k = end + 1
        if not found:
            return
        at = found.end() if found[0] == ">" else found.start()
        yield i, at, m[0].lower(), closing, html[m.end() : found.start()]


class Page:
    """Nodes of one page; a node's parent comes before it. Leaves have text. Parsing takes time in proportion to the page, whatever it holds."""

    def __init__(self, html: str):
        self.parent, self.kind, self.bits, self.text, self.links = [-1], [KINDS.index("root")], [0], [None], [0]
        self._parse(html)

    def _node(self, parent: int, kind: int, bits: int, text: str | None = None, links: int = 0) -> int:
        for column, v in ((self.parent, parent), (self.kind, kind), (self.bits, bits), (self.text, text), (self.links, links)):
            column.append(v)
        return len(self.parent) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]
        places: dict[str, list[int]] = {}  # of each name, where it lies in the stack
        inline: list[str] = []
        links = linked = at = 0
        endless: set[str] = set()  # names of raw elements that no end follows

        def cut(k: int) -> None:
            while len(stack) > k:
                places[stack.pop()[0]].pop()

        def place(names: Iterable[str]) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        def flush() -> None:
            text = " ".join(unescape("".join(inline)).split())
            if text:
                self._node(stack[-1][1], 0, 0, text, min(links, len(text)))
            inline.clear()

        for begin, end, name, closing, attributes in tags(html):
            if begin < at:
                continue  # inside a raw element
            if begin > at:
                inline.append(html[at:begin])
                links += (begin - at) * linked
            at = end
            if name in RAW:
                if not closing and name not in endless:
                    m = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(html, end)
                    if m:
                        close = html.find(">", m.end())
                        at = len(html) if close < 0 else close + 1
                    else:
                        endless.add(name)
                        if name in ("script", "style", "textarea", "title"):
                            at = len(html)
            elif name == "br" or name == "hr":
                inline.append(" ")
            elif name == "a":
                linked = int(not closing)
            elif name in BLOCK:
                flush()
                links = linked = 0
                if closing:
                    k = place([name])
                    if k and name not in ("html", "body"):
                        cut(k)
                elif name not in ("html", "body"):
                    if stack[-1][0] == "p":
                        cut(len(stack) - 1)
                    ends = place(ENDS.get(name, ()))
                    if ends and ends > place(STOPS):
                        cut(ends)
                    bits = 0
                    if attributes:
                        for a in ATTRIBUTE.findall(attributes):
                            for t in TOKEN.findall(a):
                                bits |= BIT.get(t.lower(), 0)
                    places.setdefault(name, []).append(len(stack))
                    stack.append((name, self._node(stack[-1][1], KINDS.index(KIND[name]), bits)))
        if at < len(html):
            inline.append(html[at:])
            links += (len(html) - at) * linked
        flush()


def features(page: Page) -> np.ndarray:
    """One row of features for each node."""
    n = len(page.parent)
    parent = np.array(page.parent)
    kind = np.array(page.kind)
    bits = np.array(page.bits)
    size = [len(t) if t else 0 for t in page.text]
    start = np.cumsum(size) - size
    marks = [t.count(".") + t.count(",") + t.count("?") + t.count("!") if t else 0 for t in page.text]
    words = [t.count(" ") + 1 if t else 0 for t in page.text]
    sums = np.array([size, page.links, marks, words, (kind == 0).astype(int), np.ones(n, int), (kind == 1).astype(int), (kind == 2).astype(int)], np.float64)
    total = [list(x) for x in sums]
    depth, above, above_kind, children, index = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for v in range(1, n):
        p = page.parent[v]
        depth[v] = depth[p] + 1
        above[v] = above[p] | page.bits[p]
        above_kind[v] = above_kind[p] | 1 << page.kind[p]
        index[v] = children[p]
        children[p] += 1
    for column in total:
        for v in range(n - 1, 0, -1):
            column[page.parent[v]] += column[v]
    size_, links, marks_, words_, leaves, nodes, paras, heads = map(np.array, total)
    up = np.maximum(parent, 0)
    brothers = np.array(children)[up]
    columns = [np.array(depth), np.log1p(size_), np.log1p(nodes), size_ / nodes, links / np.maximum(size_, 1), marks_ / np.maximum(words_, 1), np.log1p(marks_), words_ / np.maximum(leaves, 1), brothers, np.array(index) / np.maximum(brothers, 1), np.log1p((size_[up] - size_) / np.maximum(brothers - 1, 1)), size_ / max(size_[0], 1), start / max(size_[0], 1), size_[up] / max(size_[0], 1), paras, heads, links[up] / np.maximum(size_[up], 1), kind[up]]
    columns += [kind == k for k in range(len(KINDS))]
    columns += [(bits >> g) & 1 for g in range(N_GROUPS)]
    columns += [(np.array(above) >> g) & 1 for g in range(N_GROUPS)]
    columns += [(np.array(above_kind) >> KINDS.index(k)) & 1 for k in ("article", "main", "nav", "header", "footer", "aside", "form", "list", "table", "section")]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


class Boosted:
    """Gradient-boosted trees for a yes-or-no target: logistic loss, histograms, second-order leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1).astype(np.int64)
        n, k = x.shape
        self.feature = np.zeros((trees, 2**depth), np.int64)
        self.cut = np.full((trees, 2**depth), np.inf, np.float32)
        self.value = np.zeros((trees, 2 ** (depth + 1)), np.float32)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.ones(n, np.int64)
            for d in range(depth):
                width = 2 ** (d + 1)
                best_gain, best = np.zeros(width), np.full((width, 2), -1)
                for f in range(k):
                    b = len(self.edges[f]) + 1
                    if b < 2:
                        continue
                    key = node * b + binned[:, f]
                    gs = np.bincount(key, g, width * b).reshape(width, b).cumsum(1)
                    hs = np.bincount(key, h, width * b).reshape(width, b).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    c = gain.argmax(1)
                    top = gain[np.arange(width), c]
                    better = top > best_gain + 1e-6
                    best_gain[better] = top[better]
                    best[better] = np.stack([np.full(width, f), c], 1)[better]
                right = np.zeros(n, bool)
                for v in range(width // 2, width):
                    if best[v, 0] >= 0:
                        f, c = best[v]
                        self.feature[t, v], self.cut[t, v] = f, self.edges[f][c]
                        own = node == v
                        right[own] = binned[own, f] > c
                node = 2 * node + right
            gs, hs = np.bincount(node, g, 2 ** (depth + 1)), np.bincount(node, h, 2 ** (depth + 1))
            self.value[t] = rate * gs / (hs + 1)
            score += self.value[t][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.value)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.value[t, node]
        return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Likeliest labels of which no 1 lies below a 0."""
    n = len(parent)
    p = np.clip(odds, -30, 30)
    yes, no = (-np.logaddexp(0, -p)).tolist(), (-np.logaddexp(0, p)).tolist()
    for v in range(n - 1, 0, -1):
        yes[parent[v]] += max(yes[v], no[v])
        no[parent[v]] += no[v]
    label = np.zeros(n, bool)
    label[0] = yes[0] >= no[0]
    for v in range(1, n):
        label[v] = label[parent[v]] and yes[v] >= no[v]
    return label


def generated(seed: int) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    r = random.Random(seed)
    letters = r.choice(["aeioubcdfglmnprst", "aeiouäöükrstnmhlg", "éèaeiouçlmnrpst", "aeoiñáuclmnrdst", "абвгдеклмнопрст", "αβγδεικλμνοπρστ"])
    syllables = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 60))]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    junk = r.choice(["", "", "", "%%%", "&", "***"])
    words = lambda a, b: " ".join(word() + (junk if junk and r.random() < 0.4 else "") for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 16).capitalize() + r.choice([".", ".", ".", "!", "?"])
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    pick = lambda g: r.choice(GROUPS[g].split())
    name = lambda g: r.choice(["", f' class="{pick(g)}"', f' id="{pick(g)}"', f' class="{pick(g)}-{word()}"', f' class="x-{pick(g)} {word()}"'])
    sure = lambda g: r.choice([f' class="{pick(g)}"', f' id="{pick(g)}"', f' class="{word()} {pick(g)}"'])
    blocks: list[str] = []

    def block(tag: str, text: str, attributes: str = "") -> str:
        blocks.append(" ".join(text.split()))
        body = escape(text, quote=False)
        if r.random() < 0.2 and " " in body and "&" not in body:
            parts = body.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice([f"<b>{parts[k]}</b>", f'<a href="/x">{parts[k]}</a>', f"<i>{parts[k]}", f"{parts[k]}<br>"])
            body = " ".join(parts)
        return f"<{tag}{attributes}>{body}" + ("" if tag in ("p", "li") and r.random() < 0.25 else f"</{tag}>")

    def link_list() -> str:
        item = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(3, 9))) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(item() for _ in range(r.randint(3, 9)))

    def box(tags: list[str], group: str, body: str, named: bool = False) -> str:
        tag = r.choice(tags)
        return f"<{tag}{(sure if named or tag == 'div' else name)(group)}>{body}</{tag}>"

    para = lambda: f"<p>{prose(1, 4)}</p>" if r.random() < 0.6 else prose(1, 2)
    menu = lambda: box(["nav", "nav", "div", "ul"], "menu", link_list())
    advert = lambda: box(["div", "aside", "section", "p"], "advert", r.choice([prose(1, 1), words(2, 12), para()]), True)
    head = lambda: box(["header", "div"], "head", r.choice([f"<h1>{words(1, 3)}</h1>", words(1, 4), f'<a href="/">{words(1, 3)}</a>']) + r.choice(["", menu(), f"<p>{words(2, 8)}</p>"]), True)
    foot = lambda: box(["footer", "footer", "div"], "foot", r.choice(["&copy; ", f"© {r.randint(1998, 2030)} ", ""]) + r.choice([words(1, 6) + r.choice([" &middot; ", " | ", ", "]) + prose(1, 3), f"www.{word()}.example " + prose(1, 2), para(), prose(1, 3), link_list()]))
    side = lambda: box(["aside", "div", "section"], "side", f"<h3>{words(1, 3)}</h3>" + r.choice([link_list(), para(), para() + link_list(), para() + para()]), True)
    notice = lambda: box(["div", "section", "aside"], "notice", para() + r.choice(["", "<button>ok</button>"]), True)
    form = lambda: f'<form{name("form")}><label>{words(1, 3)}</label><input name="q">{r.choice(["", "<p>" + prose(1, 1) + "</p>"])}<button>{word()}</button></form>'
    share = lambda: box(["div", "ul", "p"], "share", link_list() if r.random() < 0.6 else words(2, 6), True)

    def comments() -> str:
        one = lambda: box(["div", "li", "article", "section"], "comment", r.choice([f"<b>{word()}</b>", f"<h4>{words(1, 2)}</h4>", ""]) + f"<p>{prose(1, 5)}</p>", True)
        return box(["section", "div", "ol", "aside"], "comment", r.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))), True)

    def article() -> str:
        out = []
        title = words(2, 9)
        if r.random() < 0.85:
            out.append(block("h1", title))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.78:
                out.append(block("p", prose(1, r.choice([1, 3, 6]))))
            elif k < 0.86:
                out.append(block(r.choice(["h2", "h3"]), words(1, 6)))
            elif k < 0.92:
                out.append("<ul>" + "".join(block("li", words(2, 14)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.96:
                out.append(block("blockquote", prose(1, 2)))
            else:
                out.append("<table><tr>" + "".join(block("td", words(1, 4)) for _ in range(3)) + "</tr></table>")
            if r.random() < 0.08:
                out.append(r.choice([advert, share, notice])())
        if not blocks or r.random() < 0.2:
            out.append(block("p", prose(1, 2)))
        if r.random() < 0.3:
            out.insert(0, "") if r.random() < 0.7 else out.append(share())
        text = "".join(out)
        if r.random() < 0.15:
            text += comments() if r.random() < 0.6 else advert()
        return text

    shape = r.random()
    main = article()
    if shape < 0.4:
        main = f"<article{name('content')}>{main}</article>"
    elif shape < 0.55:
        main = f"<main{name('content')}>{main}</main>"
    elif shape < 0.65:
        main = f"<main><article>{main}</article></main>"
    elif shape < 0.9:
        main = f"<div{sure('content')}>{main}</div>"
    else:
        main = f"<div>{main}</div>"
    before = [f() for f in (head, menu, notice, advert, form, side) if r.random() < 0.4]
    after = [f() for f in (comments, side, advert, form, share, notice, menu) if r.random() < 0.3]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.85:
        after.append(foot())
    wrap = r.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page">{}</div>'])
    body = wrap.format("".join(before) + main + "".join(after))
    tail = r.choice(["</body></html>", "</body></html>", ""])
    extra = lambda: r.choice(["", f"<style>.{word()}{{color:red}} p > a{{margin:{r.randint(0, 9)}px}}</style>", f"<script>if (a < b) {{ document.write('<p>{word()}</p>'); }}</script>", f'<script src="/{word()}.js"></script>', f'<meta name="description" content="{words(3, 9)}">', f"<!-- {words(1, 5)} <p> -->", f"<noscript><p>{words(2, 6)}</p></noscript>"])
    head_ = r.choice(["<!DOCTYPE html>", "<!doctype html>", ""]) + f"<html><head>{extra()}<title>{words(2, 8)}</title>{extra()}{extra()}</head><body{r.choice(['', name('content')])}>"
    return f"{head_}{extra()}{body}{extra()}{tail}", blocks


def labels(page: Page, blocks: list[str]) -> np.ndarray:
    """Which nodes hold a block of the main text; the generated texts differ enough to tell by the text."""
    own = set(blocks)
    y = np.array([t in own if t else False for t in page.text])
    for v in range(len(y) - 1, 0, -1):
        if y[v]:
            y[page.parent[v]] = True
    return y


@cache
def trained(pages: int = PAGES) -> Boosted:
    xs, ys = [], []
    for seed in range(pages):
        html, blocks = generated(seed)
        page = Page(html)
        xs.append(features(page))
        ys.append(labels(page, blocks))
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def extracted(htmls: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    sizes = [len(p.parent) for p in pages]
    odds = model.score(np.concatenate([features(p) for p in pages]))
    out, at = [], 0
    for page, n in zip(pages, sizes):
        keep = decode(page.parent, odds[at : at + n])
        out.append("\n\n".join([t for t, k in zip(page.text, keep) if k and t]))
        at += n
    return out


def _extracting(model: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                texts = extracted(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(_extracting(trained()), SCHEMA)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
