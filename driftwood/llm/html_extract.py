"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every node of a page is described by its tag, its attribute tokens, the density
of its subtree, depth and sibling statistics. Boosted trees, fitted by Spark on
labelled nodes of training pages, give its probability of leading to main text.
Decoding is hierarchical: leaving out a node leaves out all below it, and the
choice over the whole tree has the highest likelihood, so that no kept node
stands below one that was left out.

Training pages are composed from the words of a bounded sample of pages in many
random layouts (with menus, headers, footers, sidebars, notices, adverts, forms,
comments); the composer knows which nodes are the article, so labels need no
template of the pages themselves. Parts stand in semantic tags, in elements with
telling names, or in ones whose names say nothing; the article may also stand in
nested boxes, straight in the body, or be a fragment without a page around it.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bytes_
from driftwood.sources.workspace import written

#: Pages whose words are used, and training pages composed from each. The most that the fit sees.
TRAIN_PAGES, LAYOUTS = 300, 3

# What HTML defines about elements, and words that sites use for the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
TAG_GROUPS = {
    "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside", "form": "form input button select label fieldset textarea option legend",
    "article": "article main", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd", "table": "table tbody thead tr td th", "link": "a",
    "inline": "b i em strong span small u s mark code sub sup", "head": "head title meta link", "box": "div section", "quote": "blockquote pre figure figcaption",
}
WORD_GROUPS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs pagination pager toc", "head": "header masthead banner topbar logo branding", "foot": "footer copyright colophon legal bottom",
    "side": "sidebar aside side widget related rail recommended recommendations trending complementary popular", "ad": "ad ads advert advertisement advertising sponsor sponsored promo promoted promotion adsense",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription paywall gdpr overlay toast dialog", "comment": "comment comments reply replies discussion disqus respond responses thread",
    "share": "share sharing social follow tags byline meta", "form": "form search login signin signup register contentinfo", "content": "article content post entry story body main text prose page",
}
_TAG_GROUP = {t: i for i, x in enumerate(TAG_GROUPS.values()) for t in x.split()}
_WORD_GROUP = {t: i for i, x in enumerate(WORD_GROUPS.values()) for t in x.split()}
NUMBERS = "depth log_chars link_share tags chars_per_tag own_share siblings place alike_siblings page_share page_start marks parent_log_chars parent_link_share log_chars_before log_chars_after text_siblings".split()
FEATURES = len(NUMBERS) + 3 * (len(TAG_GROUPS) + len(WORD_GROUPS))

#: A quote opens a value only after an equals sign; a tag without end goes on to the end of the page. Every alternative
#: takes what it has looked at, so that a page is read once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.DOTALL
)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_MAIN = " data-composed-main"


class Page:
    """The nodes of a page, parents first, and its pieces of text."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.words, self.marked = [-1], ["#"], [frozenset()], [False]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        stack, block, at = [0], 0, 0
        opened: dict[str, list[int]] = {}  # for each tag, where its open elements are in the stack
        tags = self.tag

        def close(to: int) -> None:
            for node in stack[to:]:
                opened[tags[node]].pop()
            del stack[to:]

        def close_last(which: tuple[str, ...], within: tuple[str, ...]) -> None:
            """Closes the last open element of these tags, unless one of the tags of ``within`` was opened after it."""
            last = lambda names: max((opened[x][-1] for x in names if opened.get(x)), default=0)
            if (to := last(which)) > last(within):
                close(to)

        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self.pieces.append((stack[-1], block, source[at : m.start()]))
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], block, m[0][9:].removesuffix("]]>")))
                continue
            name = m[2].lower()
            if m[1]:
                if opened.get(name):
                    close(opened[name][-1])
                block += name in BLOCK
                continue
            if name in BLOCK:
                block += 1
                close_last(("p",), ("td", "th", "button", "table"))
            if name in CLOSES:
                close_last(*CLOSES[name])
            self.parent.append(stack[-1])
            tags.append(name)
            self.words.append(frozenset(w for a in _ATTR.findall(m[3]) for w in re.split("[^a-z]+", "".join(a).lower())) if "=" in m[3] else frozenset())
            self.marked.append(_MAIN in m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
            elif name == "br":
                self.pieces.append((stack[-1], block, " "))
            elif name not in VOID and not m[3].endswith("/"):
                opened.setdefault(name, []).append(len(stack))
                stack.append(len(tags) - 1)
        if at < len(source):
            self.pieces.append((stack[-1], block, source[at:]))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent, own, links, marks = self.parent, np.zeros(n), np.zeros(n), np.zeros(n)
        start, total = np.full(n, -1.0), 0
        for node, _, text in self.pieces:
            chars = len(text.strip())
            if chars:
                own[node] += chars
                marks[node] += text.count(".") + text.count(",")
                if start[node] < 0:
                    start[node] = total
                total += chars
        depth, children, index, tags_below = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = children[p]
            children[p] += 1
            alike[p, self.tag[i]] = alike.get((p, self.tag[i]), 0) + 1
        chars = own.copy()
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if self.tag[i] == "a":
                links[i] = chars[i]
            for x in (chars, links, marks, tags_below):
                x[p] += x[i]
            if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
                start[p] = start[i]
        x = np.zeros((n, FEATURES), np.float32)
        k, g, w = len(NUMBERS), len(TAG_GROUPS), len(WORD_GROUPS)
        for i in range(n):
            if (t := _TAG_GROUP.get(self.tag[i])) is not None:
                x[i, k + t] = 1
            for word in self.words[i]:
                if (t := _WORD_GROUP.get(word)) is not None:
                    x[i, k + g + t] = 1
        flags = x[:, k : k + g + w]
        above, below = x[:, k + g + w : k + 2 * (g + w)], x[:, k + 2 * (g + w) :]
        for i in range(1, n):
            above[i] = np.maximum(above[parent[i]], flags[parent[i]])
        for i in range(n - 1, 0, -1):
            np.maximum(below[parent[i]], np.maximum(below[i], flags[i]), out=below[parent[i]])
        around = children[np.maximum(parent, 0)]
        same = [1, *(alike[parent[i], self.tag[i]] for i in range(1, n))]
        least = np.maximum(chars, 1)
        # the nodes before and after under the same parent, and how many nodes there have much text
        before, after, last_child = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        texts_in, up = np.zeros(n), np.maximum(parent, 0)
        for i in range(1, n):
            p = parent[i]
            texts_in[p] += chars[i] > 60
            if last_child[p] >= 0:
                before[i], after[last_child[p]] = last_child[p], i
            last_child[p] = i
        log_chars = np.log1p(chars)
        beside = lambda x: np.where(x >= 0, log_chars[x], -1)
        numbers = (depth, log_chars, links / least, tags_below, chars / tags_below, own / least, around, index / np.maximum(around, 1), same / np.maximum(around, 1), chars / max(total, 1), np.maximum(start, 0) / max(total, 1), marks / least,
                   log_chars[up], (links / least)[up], beside(before), beside(after), texts_in[up])
        x[:, :k] = np.stack(numbers, axis=1)
        return x

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest choice of nodes in which the parent of a kept node is kept."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        for i in range(len(p) - 1, 0, -1):  # yes: best below if kept; no: all below left out
            yes[self.parent[i]] += max(yes[i], no[i])
            no[self.parent[i]] += no[i]
        kept = np.zeros(len(p), bool)
        kept[0] = True
        for i in range(1, len(p)):
            kept[i] = kept[self.parent[i]] and yes[i] > no[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if kept[node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
        return "\n".join(x for x in lines if x)


#: Names that training pages give to the parts of a page.
MAIN_NAMES = ["content", "post", "article-body", "entry-content", "story", "main-text", "post-content"]
PART_NAMES = {
    "nav": ["menu", "navbar", "main-nav", "breadcrumbs"], "header": ["header", "masthead", "topbar", "banner"], "footer": ["footer", "site-footer", "copyright", "colophon"],
    "aside": ["sidebar", "widget", "related", "trending"], "ad": ["ad", "ads", "advert", "sponsored", "promo-box"], "notice": ["cookie-notice", "consent", "notice", "popup", "newsletter", "alert"],
    "comments": ["comments", "comment-list", "discussion", "replies", "disqus_thread", "reader-comments", "responses", "comment-thread"],
    "end": ["entry-footer", "post-meta", "tags", "share", "social-share", "byline", "author-meta"], "hero": ["hero", "headline", "page-title", "title-box", "lead-header"],
}


class Composer:
    """Makes training pages; the article's blocks carry a mark that features do not see.

    On plain pages no name tells anything, so only parts that their form tells
    apart from an article (lists of links, forms, short ends) stand beside it.
    """

    def __init__(self, words: list[str], rng: random.Random) -> None:
        self.words, self.rng = words, rng
        self.plain = rng.random() < 0.35

    def say(self, a: int, b: int) -> str:
        return html.escape(" ".join(self.rng.choices(self.words, k=self.rng.randint(a, b))))

    def one(self, *options):
        return self.rng.choice(options)()

    def name(self) -> str:
        """A name without meaning."""
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=self.rng.randint(1, 5))) + self.rng.choice(("", "", str(self.rng.randint(1, 99))))

    def tag(self, tag: str, names: list[str], inner: str, chance: float = 1.0) -> str:
        rng, attr = self.rng, ""
        if rng.random() < chance:
            if names and not self.plain:
                attr = " ".join([rng.choice(names), *(self.name() for _ in range(rng.choice((0, 0, 1, 2))))])
            else:
                attr = self.name()
            attr = f' {rng.choice(("class", "id"))}="{attr}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def part(self, kind: str, inner: str, semantic: str = "") -> str:
        if semantic and self.rng.random() < (0.3 if self.plain else 0.55):
            return self.tag(semantic, PART_NAMES.get(kind, []), inner, 0.2)
        return self.tag(self.rng.choice(("div", "div", "section", "ul" if kind == "nav" and inner.startswith("<li") else "div")), PART_NAMES.get(kind, []), inner)

    def links(self) -> str:
        rows = [f'<a href="/{i}">{self.say(1, 3)}</a>' for i in range(self.rng.choice((self.rng.randint(2, 9), self.rng.randint(2, 9), self.rng.randint(10, 45))))]
        return self.one(lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>", lambda: " | ".join(rows), lambda: "".join(f"<li>{x}" for x in rows))

    def paras(self, n: int, mark: str = "", least: int = 3) -> str:
        rng = self.rng
        return "".join(f"<p{mark}>{self.say(least, 90)}" + ("<br>" if rng.random() < 0.1 else "") + ("</p>" if rng.random() < 0.9 else "") for _ in range(n))

    def block(self) -> str:
        kind, say = self.rng.random(), self.say
        if kind < 0.6:
            return self.paras(1, _MAIN, self.rng.choice((1, 3, 3)))
        if kind < 0.64:  # a line in bold, closed or not
            return f"<p{_MAIN}><b>{say(1, 5)}" + self.one(lambda: "</b></p>", lambda: "<br>", lambda: "</b>")
        if kind < 0.71:
            return f"<h{2 + int(kind * 100) % 3}{_MAIN}>{say(1, 6)}</h{2 + int(kind * 100) % 3}>"
        if kind < 0.81:
            return f"<ul{_MAIN}>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>"
        if kind < 0.87:
            return f'<p{_MAIN}>{say(2, 20)} <a href="/x">{say(1, 3)}</a> <b>{say(1, 4)}</b>, <em>{say(1, 3)}</em>.</p>'
        if kind < 0.91:
            return f"<blockquote{_MAIN}>{self.paras(1)}</blockquote>"
        if kind < 0.95:
            return f"<div{_MAIN}>{say(8, 90)}</div>"
        return f"<table{_MAIN}>" + "".join(f"<tr><td>{say(1, 4)}<td>{say(1, 9)}</tr>" for _ in range(self.rng.randint(1, 4))) + "</table>"

    def comments(self) -> str:
        """What readers say: a heading, then one box each, with a name and a text as long as an article's."""
        rng, say = self.rng, self.say
        who = lambda: self.one(lambda: "", lambda: f"<b>{say(1, 2)}</b>", lambda: f'<span class="author">{say(1, 2)}</span>', lambda: f"<h4>{say(1, 3)}</h4>")
        each = [self.tag(rng.choice(("div", "li", "article", "section")), ["comment", "reply", "comment-body", "response"], who() + self.one(lambda: self.paras(1), lambda: say(3, 60)), 0.8) for _ in range(rng.randint(1, 6))]
        title = f"<h{rng.choice('234')}>{say(1, 3)}</h3>" if rng.random() < 0.6 else ""
        return self.tag(rng.choice(("div", "section", "section", "aside")), PART_NAMES["comments"], title + "".join(each))

    def ending(self) -> str:
        """Where a text is filed, who wrote it, where to share it."""
        say = self.say
        inner = self.one(lambda: f"{say(1, 3)}: <a href='/t'>{say(1, 2)}</a>, <a href='/u'>{say(1, 2)}</a>", lambda: f"<p>{say(1, 6)}</p>", lambda: self.links(), lambda: f"<span>{say(1, 4)}</span> <time>{say(1, 2)}</time>")
        return self.part("end", inner, self.rng.choice(("footer", "footer", "header", "")))

    def article(self) -> str:
        rng = self.rng
        title = f"<h1{_MAIN}>{self.say(2, 9)}</h1>" if rng.random() < 0.75 else ""
        blocks = [self.block() for _ in range(rng.choice((0, 1, 2, 2, 3, 6, 12) if title else (1, 2, 3, 6)))]
        if not title:
            blocks[0] = self.paras(1, _MAIN)
        if not self.plain and rng.random() < 0.25:
            blocks.insert(rng.randint(0, len(blocks)), self.part("ad", self.say(2, 15)))
        outside = ""
        if title and len(blocks) > 1 and rng.random() < 0.15:  # a headline in a box of its own
            outside, title = self.part("hero", title, "header" if rng.random() < 0.3 else ""), ""
        inner = title + "".join(blocks)
        how = rng.random()
        if not self.plain and len(blocks) > 1:
            if rng.random() < 0.2:
                inner = self.ending() + inner if rng.random() < 0.3 else inner + self.ending()
            if how < 0.8 and rng.random() < 0.2:
                inner += self.comments()
        if how < (0.15 if self.plain else 0.45):
            inner = self.tag(rng.choice(("article", "main")), MAIN_NAMES, inner, 0.3)
        elif how < 0.8:
            for _ in range(rng.choice((1, 1, 2, 4))):
                inner = self.tag(rng.choice(("div", "div", "section", "td")), MAIN_NAMES, inner, 0.9)
        return outside + inner

    def page(self) -> str:
        rng, say = self.rng, self.say
        article = self.article()
        if rng.random() < 0.08:
            return article
        before, after = [], []
        if rng.random() < 0.5:
            name = self.one(lambda: f'<a href="/">{say(1, 3)}</a>', lambda: f"<b>{say(1, 3)}</b>", lambda: f'<a href="/">{say(1, 3)}</a>' if self.plain or rng.random() < 0.5 else f"<h2>{say(1, 3)}</h2>")
            before.append(self.part("header", name + (f"<p>{say(2, 8)}</p>" if not self.plain and rng.random() < 0.5 else ""), "header"))
        if rng.random() < 0.8:
            (before if rng.random() < 0.8 else after).append(self.part("nav", self.links(), "nav"))
        if rng.random() < 0.35:
            after.append(self.part("aside", (f"<h3>{say(1, 4)}</h3>" if rng.random() < 0.5 else "") + (self.links() if self.plain or rng.random() < 0.5 else self.paras(2)), "aside"))
        if not self.plain:
            if rng.random() < 0.6:
                rng.choice((before, after)).append(self.part("ad", self.one(lambda: say(2, 25), lambda: f"<p>{say(2, 25)}</p>", lambda: f'<a href="/y">{say(2, 9)}</a>')))
            if rng.random() < 0.4:
                rng.choice((before, after)).append(self.part("notice", f"<p>{say(4, 25)}</p><button>{say(1, 2)}</button>"))
            if rng.random() < 0.35:
                after.append(self.comments())
        if rng.random() < 0.3:
            rng.choice((before, after)).append(f"<form {rng.choice(('', 'class=search', 'id=login'))}><label>{say(1, 4)}</label><input name=q><button>{say(1, 2)}</button></form>")
        if rng.random() < 0.8:
            after.append(self.part("footer", f"&copy; {say(1, 9 if self.plain else 30)}" + (self.links() if rng.random() < 0.3 else ""), "footer"))
        body = "".join([*before, article, *after])
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            body = self.tag("div", ["page", "wrapper", "container"], body)
        head = f"<head><title>{say(2, 8)}</title><style>p{{}}</style></head>"
        return body if rng.random() < 0.1 else f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def compose(words: list[str], rng: random.Random) -> str:
    return Composer(words, rng).page()


def labels(page: Page) -> np.ndarray:
    """1 for nodes of a composed page inside of marked ones or above them."""
    out = np.array(page.marked, np.float64)
    for i in range(1, len(out)):
        out[i] = max(out[i], out[page.parent[i]])
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] = max(out[page.parent[i]], out[i])
    return out


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for seed, source in zip(batch["seed"], batch["html"], strict=True):
            words = re.sub("<[^>]*>", " ", source or "").split()
            rng = random.Random(int(seed))
            for _ in range(LAYOUTS if words else 0):
                page = Page(compose(words, rng))
                yield pd.DataFrame({"features": list(page.features().astype(float)), "label": labels(page)})


def fitted(pages: DataFrame, most: int = TRAIN_PAGES) -> list[tuple[np.ndarray, ...]]:
    """Boosted trees as arrays (feature, threshold, left, right, value), fitted on pages composed from ``most`` pages at most."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    seed = F.xxhash64("page_id", "html")
    sample = pages.where("html is not null").select(seed.alias("seed"), "html").orderBy("seed").limit(most)
    nodes = written(sample.mapInPandas(_composed, "features array<double>, label double"), "training-nodes").coalesce(8)
    nodes = nodes.select(array_to_vector("features").alias("features"), "label")
    if nodes.isEmpty():
        return []
    model = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.3, seed=7, maxMemoryInMB=128).fit(nodes)

    def flat(node) -> tuple[np.ndarray, ...]:
        rows: list[list[float]] = []

        def walk(x) -> int:
            i = len(rows)
            rows.append([-1, 0.0, 0, 0, x.prediction()])
            if x.subtreeDepth() > 0:
                rows[i][:2] = x.split().featureIndex(), x.split().threshold()
                rows[i][2], rows[i][3] = walk(x.leftChild()), walk(x.rightChild())
            return i

        walk(node)
        a = np.array(rows)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    return [(*flat(tree._java_obj.rootNode()), weight) for tree, weight in zip(model.trees, model.treeWeights, strict=True)]


def probability(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, threshold, left, right, value, weight in trees:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            to_left = x[i, feature[at[i]]] <= threshold[at[i]]
            at[i] = np.where(to_left, left[at[i]], right[at[i]])
        total += weight * value[at]
    return 1 / (1 + np.exp(-2 * total))


def _extracted(trees: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in bytes_.slices(batches, "html"):
            pages = [Page(x or "") for x in batch.column("html").to_pylist()]
            p = probability(trees.value, np.concatenate([x.features() for x in pages]))
            ends = np.cumsum([len(x.tag) for x in pages])
            out = [page.text(page.decode(p[end - len(page.tag) : end])) for page, end in zip(pages, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The main text of every page from its whole html.

    pages: ``page_id`` bigint, ``url``, ``html``; other columns are ignored.
    ``train`` (pages itself, if not given) lends its words to the training
    pages, TRAIN_PAGES of its rows at most. Returns page_id, url, text and
    n_chars. Character references are decoded, white space inside a block is
    one space, blocks are joined by \\n in page order. Null and empty html, and
    pages without main text, give ''. Repeated rows are each returned; an empty
    table gives no rows. A very long page is read once, and its nodes are held.
    Where leaving a node out and keeping it are equally likely it is left out.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    trees = pages.sparkSession.sparkContext.broadcast(fitted(pages if train is None else train))
    return pages.mapInArrow(_extracted(trees), "page_id long, url string, text string, n_chars long")
