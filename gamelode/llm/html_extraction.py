"""Operator 2, main text of HTML pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements, forms, and inline elements that bear a class, id or role; other inline elements
belong to the node they stand in. Each node gets features: text and tag density of its subtree, link density, tokens of
class, id and role (a short list of tell-tale words, and hash bins for all others), depth, place and likeness among its
siblings, and landmarks above it. Gradient-boosted trees give the probability that a node holds main text. Decoding is over the whole tree: a node can only be kept if its parent
is, and of all such choices the likeliest is taken, so no kept block lies in a dropped one.

Training is bounded: SYNTHETIC labelled pages of many layouts made here from a seed, and at most WEAK pages of the given
table, their first WEAK_CHARS characters, whose landmark elements tell article and surroundings apart. Every page is then
read whole.

Text: character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined in
page order by one line break. Scripts, styles, controls of forms, comments of the markup and the head never count as text. A
form is judged like any other node, so that one around the whole page does not take the article with it.

Defined cases: a null or empty page, or one without main text, has the empty text; broken markup is read as browsers do in
the common cases (unclosed paragraphs, cells and list items; stray end tags are ignored; text, or an element that cannot
stand in it, ends the head; a slash at the end of a start tag means nothing outside of svg and math; a button, svg or the
like that is never closed ends with its parent or before the next block; a quote that is never closed ends with its tag);
repeated rows are separate; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SYNTHETIC, WEAK, TREES, DEPTH = 600, 150, 30, 4
WEAK_CHARS = 200_000  #: of a page that trains; no other page is cut

# Element names and tell-tale words.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe svg math canvas object button select textarea audio video datalist #unclosed".split())
CONTROLS = frozenset("input select textarea button label".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
FOREIGN = frozenset(("svg", "math"))
UNCLOSED = "#unclosed"  # a skipped element without an end tag: the next block, or the end of its parent, ends it
TO_THE_END = frozenset(("script", "style"))  # without an end tag these go on to the end of the page
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
GROUPS = ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "table tbody tr td th thead", "nav menu", "header", "footer", "aside", "blockquote pre figure figcaption", "body html", "form fieldset", "a b i em strong span small u s mark cite code q sub sup label font abbr time ins del")
GROUP_OF = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
AWAY = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus foot footer form header login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split())
TOWARDS = frozenset("article body content copy entry main paragraph post story text".split())
BINS = 8

# a value is quoted only after "="; no part gives back what it has taken
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|[^>]*+>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""", re.I)
TOKEN = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Page:
    """Parallel lists over nodes in page order (parents come first), and the blocks of text."""

    def __init__(self, text: str):
        self.tag, self.parent, self.depth, self.tokens, self.truth = ["html"], [-1], [0], [()], [None]
        self.lines: list[list[tuple[int, str]]] = []  # each block's pieces of text with their nodes
        self.own, self.links, self.marks, self.tags, self.controls = [0], [0], [0], [1], [0]
        self._parse(text)

    def _flush(self, run: list[tuple[int, str]]) -> None:
        if not run:
            return
        # neighbours of one node become one piece
        pieces = [(node, "".join(t for _, t in some)) for node, some in groupby(run, key=itemgetter(0))]
        run.clear()
        if any(t.strip() for _, t in pieces):
            self.lines.append(pieces)
            for node, text in pieces:
                self.own[node] += len(" ".join(text.split()))
                self.marks[node] += text.count(",") + text.count(".")

    @property
    def blocks(self) -> list[tuple[int, str]]:
        """The text of each block with its outermost node."""
        return [(min(n for n, _ in pieces), " ".join("".join(t for _, t in pieces).split())) for pieces in self.lines]

    def _open(self, name: str, attributes: str, parent: int, depth: int) -> int:
        truth, found = None, []
        for a, *v in ATTRIBUTE.findall(attributes):
            v = v[0] or v[1] or v[2]
            if a.lower() == "data-y":
                truth = v == "1"
            else:
                found += [t.lower() for t in TOKEN.findall(v)]
        for of, x in ((self.tag, name), (self.parent, parent), (self.depth, depth), (self.tokens, tuple(found)), (self.truth, truth), (self.own, 0), (self.links, 0), (self.marks, 0), (self.tags, 1), (self.controls, 0)):
            of.append(x)
        return len(self.tag) - 1

    def _parse(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their node
        run: list[tuple[int, str]] = []
        opened, never_closed = Counter(("html",)), set()  # how often each name is open; raw elements that no end tag follows

        def push(name: str, node: int) -> None:
            stack.append((name, node))
            opened[name] += 1

        def cut(k: int) -> None:
            opened.subtract(t for t, _ in stack[k:])
            del stack[k:]

        at, skip, in_link = 0, 0, 0
        end, last = len(text), text.rfind(">") + 1  # no tag begins where no end of one follows
        while at < end:
            m = TAG.search(text, at, last) if at < last else None
            stop = m.start() if m else end
            if stack[-1][0] == "head" and text[at:stop].strip():  # as text, or an element that cannot stand in it, ends the head
                cut(len(stack) - 1)
                skip -= 1
            if stop > at and not skip:
                piece = text[at:stop] if m else re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", text[at:])  # a tag cut off by the end
                piece = htmllib.unescape(piece) if "&" in piece else piece
                run.append((stack[-1][1], piece))
                if in_link:
                    self.links[stack[-1][1]] += len(piece)
            if not m:
                break
            at = end if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
            name = m[2]
            if name is None:
                continue
            name, attributes = name.lower(), m[3][:-1]
            node = stack[-1][1]
            self.controls[node] += name in CONTROLS and not m[1]
            if m[1]:  # an end tag
                if name == "a":
                    in_link = max(0, in_link - 1)
                for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                    if stack[k][0] == name:
                        if name in BLOCK or any(t in BLOCK for t, _ in stack[k:]):
                            self._flush(run)
                        if name not in BLOCK and name not in SKIPPED and any(t in BLOCK or t in SKIPPED for t, _ in stack[k + 1 :]):
                            break  # an inline end does not close blocks
                        skip -= sum(t in SKIPPED for t, _ in stack[k:])
                        cut(k)
                        break
                continue
            if stack[-1][0] == "head" and name not in IN_HEAD:
                cut(len(stack) - 1)
                skip -= 1
            if name in RAW and not (name in FOREIGN and attributes.endswith("/")):
                close = None if name in never_closed else re.compile(rf"</{name}\s*+>", re.I).search(text, at)
                if not close:
                    never_closed.add(name)
                if close or name in TO_THE_END:
                    at = close.end() if close else end
                elif name in FOREIGN:
                    push(UNCLOSED, node)
                    skip += 1
                continue
            if name in VOID or name in FOREIGN:
                self.tags[node] += 1
                if name == "br":
                    run.append((node, " "))
                elif name == "hr":
                    self._flush(run)
                continue
            if name in SKIPPED:
                following = re.compile(rf"<(/?){name}\b", re.I).search(text, at)
                closed = name == "head" or following and (following[1] or name == "object")
                push(name if closed else UNCLOSED, node)
                skip += 1
                continue
            if skip and name in BLOCK and stack[-1][0] == UNCLOSED:
                cut(len(stack) - 1)
                skip -= 1
            if skip and name == "body":
                stack = [x for x in stack if x[0] not in SKIPPED]
                opened, skip = Counter(t for t, _ in stack), 0
            if name in BLOCK:
                self._flush(run)
                if name in ("html", "body") and (name == "html" or opened["body"] > 0):
                    continue
                if "p" in (t for t, _ in stack[-6:]):  # a block ends an open paragraph
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            cut(k)
                            in_link = 0
                            break
                        if stack[k][0] in BLOCK or stack[k][0] in SKIPPED:
                            break
                if name in CLOSES:
                    closed, limits = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in limits or stack[k][0] in SKIPPED:
                            break
                        if stack[k][0] in closed:
                            cut(k)
                            break
                parent = stack[-1][1]
                push(name, self._open(name, attributes, parent, self.depth[parent] + 1))
            else:
                in_link += name == "a"
                self.tags[node] += 1
                if attributes and not skip and ATTRIBUTE.search(attributes):
                    node = self._open(name, attributes, node, self.depth[node] + 1)
                push(name, node)
        self._flush(run)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        text, links, marks, tags, controls = (list(x) for x in (self.own, self.links, self.marks, self.tags, self.controls))
        kids = [0] * n
        kids_text = [0] * n
        same: dict[tuple[int, str], int] = {}
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            links[p] += links[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            controls[p] += controls[i]
        place = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            place[i] = kids[p]
            kids[p] += 1
            kids_text[p] += text[i]
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        total, run = max(1, text[0]), 0
        before = [0] * n  # text that stands before the node
        filled = [0] * n
        x = np.zeros((n, FEATURES), dtype=np.float32)
        up_away, up_to, up_mark, up_form = [0] * n, [0] * n, [0] * n, [1.0] * n  # up_form: the nearest form's share of the text
        log = np.log1p
        for i in range(n):
            p = self.parent[i]
            if i:
                before[i] = before[p] + filled[p]
                filled[p] += text[i]
            words = self.tokens[i]
            away, to = sum(t in AWAY for t in words), sum(t in TOWARDS for t in words)
            mark = -1 if self.tag[i] in ("nav", "header", "footer", "aside") else 1 if self.tag[i] in ("article", "main") else 0
            if i:
                up_away[i], up_to[i], up_mark[i] = up_away[p] + away, up_to[p] + to, up_mark[p] or mark
                if mark < 0:
                    up_mark[i] = -1
            row = x[i]
            row[0:8] = (self.own[i], text[i], tags[i], text[i] / (tags[i] + 1), 0, kids[p] if i else 0, kids_text[p] / max(1, kids[p]) if i else 0, marks[i])
            row[8:20] = (links[i] / max(1, text[i]), self.depth[i], place[i] / max(1, kids[p]) if i else 0, same.get((p, self.tag[i]), 0) / max(1, kids[p]) if i else 0, text[i] / total, links[p] / max(1, text[p]) if i else 0, before[i] / total, 100 * marks[i] / max(1, text[i]), away, to, up_away[i], up_to[i])
            if i:
                up_form[i] = text[i] / total if self.tag[i] == "form" else up_form[p]
            row[20:24] = (up_mark[i], up_form[i], min(controls[i], 50), 100 * controls[i] / max(1, text[i]))
            g = GROUP_OF.get(self.tag[i])
            if g is not None:
                row[PLAIN + g] = 1
            for t in words:
                if t not in AWAY and t not in TOWARDS:
                    row[PLAIN + len(GROUPS) + zlib.crc32(t.encode()) % BINS] += 1
        x[:, :8] = log(x[:, :8])
        return x

    def decode(self, p: np.ndarray) -> list[bool]:
        """The likeliest choice of nodes in which no kept node has a dropped parent."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
        for i in range(n - 1, 0, -1):
            q = self.parent[i]
            keep[q] += max(keep[i], drop[i])
            drop[q] += drop[i]
        out = [True] * n
        for i in range(1, n):
            out[i] = out[self.parent[i]] and keep[i] > drop[i]
        return out

    def main_text(self, p: np.ndarray) -> str:
        kept = self.decode(p)
        lines = (" ".join("".join(t for node, t in pieces if kept[node]).split()) for pieces in self.lines)
        return "\n".join(x for x in lines if x)

    def labels(self) -> np.ndarray:
        """Of marked pages: 1 for a node with main text in it, 0 for others, -1 if the page does not tell."""
        n = len(self.tag)
        y = [-1] * n
        for i in range(1, n):
            y[i] = int(self.truth[i]) if self.truth[i] is not None else y[self.parent[i]]
        for i in range(n - 1, 0, -1):
            if y[i] == 1:
                y[self.parent[i]] = 1
        return np.array(y)

    def landmarks(self) -> bool:
        """Marks the nodes by landmark elements, if the page has one article or main element with most of the text."""
        tops = [i for i, t in enumerate(self.tag) if t in ("article", "main")]
        if len(tops) != 1:
            return False
        for i, t in enumerate(self.tag):
            if t in ("nav", "footer", "aside", "form") or any(w in AWAY for w in self.tokens[i]):
                self.truth[i] = False
        self.truth[tops[0]] = True
        return True


PLAIN = 24  #: features before those of element groups and hashed tokens
FEATURES = PLAIN + len(GROUPS) + BINS


def synthetic_page(r: random.Random) -> str:
    """A labelled page: data-y says whether an element is main text. Layout, names and lengths vary."""
    word = lambda: "".join(r.choice("aeiou bcdfglmnprst".replace(" ", "")) for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(4, 16).capitalize() + r.choice((".", ".", ".", ",", "?"))
    plain_para = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 7))))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    naming = lambda *c: r.choice((f' class="{r.choice(c)}"', f' id="{r.choice(c)}"', f' class="{word()} {r.choice(c)}"', f' class="{r.choice(c)}-{word()}"'))
    soup = r.random() < 0.5

    def para() -> str:
        """Sometimes with an inline element that bears a name, as part of the text or as an advert in it."""
        out = plain_para()
        if r.random() < 0.12:
            tag = r.choice(("span", "em", "a", "strong", "mark"))
            out += f" <{tag}{naming('term', 'link', 'note', 'name', word())}>{words(1, 6)}</{tag}> {sentence()}"
        if r.random() < 0.06:
            tag = r.choice(("span", "a", "small"))
            out += f' <{tag}{naming("ad", "ads", "advert", "sponsored", "promo", "sponsor")} data-y="0">{words(1, 8)}</{tag}> {sentence()}'
        return out

    def form() -> str:
        fields = "".join(f"<label>{words(1, 3)}</label><input name={word()}>" for _ in range(r.randint(1, 4)))
        text = r.choice(("", f"<p>{words(2, 9)}</p>", f"<h3>{words(1, 4)}</h3>"))
        return f'<form{r.choice(("", naming("search", "signup", "login", "newsletter", "comment-form", "subscribe")))} data-y="0">{text}{fields}<button>{words(1, 2)}</button></form>'

    def menu(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def away() -> str:
        kind = r.randrange(13)
        if kind == 12:
            return form()
        inner = [
            lambda: menu(r.randint(3, 12)), lambda: f"<p>{words(2, 12)}</p>", lambda: f"{words(2, 14)}.", lambda: f"<h3>{words(1, 3)}</h3>{menu(r.randint(2, 6))}",
            lambda: "".join(f"<div{naming('comment', 'reply')}><p>{para()}</p></div>" for _ in range(r.randint(1, 4))), lambda: f"&copy; {words(1, 4)} &middot; {sentence()}",
        ]
        tag, names, what = (
            ("nav", ("nav", "menu", "navbar"), 0), ("div", ("menu", "navigation", "breadcrumbs"), 0), ("header", ("header", "masthead"), 0), ("footer", ("footer", "copyright"), 5),
            ("div", ("footer", "foot"), 5), ("aside", ("sidebar", "widget"), 3), ("div", ("sidebar", "related", "widget"), 3), ("div", ("ad", "ads", "advert", "sponsored", "banner"), 2),
            ("div", ("cookie-notice", "notice", "newsletter", "consent"), 1), ("section", ("comments", "discussion"), 4), ("div", ("comments", "responses"), 4), ("div", ("share", "social", "tags"), 0),
        )[kind]
        plain = tag in ("nav", "header", "footer", "aside") and r.random() < 0.6
        return f'<{tag}{"" if plain else naming(*names)} data-y="0">{inner[what]()}</{tag}>'

    body = []
    if r.random() < 0.8:
        body.append(f"<h1>{words(2, 9)}</h1>")
    for _ in range(r.choice((1, 2, 3, 5, 9, 16))):
        kind = r.random()
        if kind < 0.72:
            body.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(para() + (link() + " " + sentence() if r.random() < 0.15 else "")))
        elif kind < 0.8:
            body.append(f"<h2>{words(1, 6)}</h2>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            body.append(f"<blockquote><p>{para()}</p></blockquote>")
        elif kind < 0.94:
            body.append(form())
        elif kind < 0.96:
            body.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        else:
            body.append(away())
    inner = "".join(body)
    tag = "div" if soup else r.choice(("article", "main", "section"))
    attributes = naming("content", "post", "entry-content", "story", "article-body", "main") if soup and r.random() < 0.75 else ""
    content = f'<{tag}{attributes} data-y="1">{inner}</{tag}>'
    for _ in range(r.randrange(3)):
        side = [away() for _ in range(r.randrange(2))]
        content = f"<div{naming('wrapper', 'container', 'page', 'row')}>{''.join(side)}{content}{away() if r.random() < 0.3 else ''}</div>"
    top, bottom = ("".join(away() for _ in range(r.randint(0, 3))) for _ in range(2))
    whole = f"{top}{content}{bottom}"
    if r.random() < 0.2:  # one form around the page
        whole = f"<form{r.choice(('', naming('pageForm', 'form', 'form1', 'main-form', 'page')))} method=post>{whole}</form>"
    return f'<html><head><title>{words(1, 5)}</title></head><body data-y="0">{whole}</body></html>'


class Trees:
    """Boosted trees as arrays; all nodes of many pages go down a tree together."""

    def __init__(self, trees: list[tuple[list[int], list[float], list[int], list[float]]], weights: list[float]):
        self.trees = [(np.array(f), np.array(t, dtype=np.float32), np.array(c), np.array(v)) for f, t, c, v in trees]
        self.weights = weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, child, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = child[at] + (x[rows, feature[at]] > threshold[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _flatten(root) -> tuple[list[int], list[float], list[int], list[float]]:
    """A tree in arrays; children lie side by side; a leaf leads to itself with a threshold that nothing exceeds."""
    feature, threshold, child, value = [0], [0.0], [0], [0.0]
    todo = [(root, 0)]
    for node, k in todo:
        value[k] = node.prediction()
        if node.subtreeDepth() == 0:
            feature[k], threshold[k], child[k] = 0, float("inf"), k
            continue
        feature[k], threshold[k], child[k] = node.split().featureIndex(), node.split().threshold(), len(feature)
        for side in (node.leftChild(), node.rightChild()):
            todo.append((side, len(feature)))
            for a in (feature, child):
                a.append(0)
            for a in (threshold, value):
                a.append(0.0)
    return feature, threshold, child, value


def train(spark: SparkSession, weak_pages: list[str], synthetic: int = SYNTHETIC, seed: int = 7) -> Trees:
    """weak_pages: html of a bounded number of given pages."""
    r = random.Random(seed)
    pages = [Page(synthetic_page(r)) for _ in range(synthetic)]
    pages += [p for p in map(Page, weak_pages) if p.landmarks()]
    rows = [(float(y), Vectors.dense(x)) for p in pages for x, y in zip(p.features().tolist(), p.labels().tolist(), strict=True) if y >= 0]
    frame = spark.createDataFrame(rows, ["label", "features"]).coalesce(4)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, seed=seed).fit(frame)
    return Trees([_flatten(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                parsed = [Page(h or "") for h in part.column(2).to_pylist()]
                x = [p.features() for p in parsed]
                p = np.split(trees.probability(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
                texts = [page.main_text(q) for page, q in zip(parsed, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = chosen.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    return chosen.mapInArrow(run, schema)


def weak_sample(pages: DataFrame, rows: int = WEAK, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    ids = pages.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    few = pages.join(F.broadcast(ids.distinct()), id_col, "left_semi").select(id_col, F.substring(F.col(html_col), 1, WEAK_CHARS).alias("html"))
    return [x.html for x in sorted(few.limit(4 * rows).collect(), key=lambda x: (x[0], x.html or "")) if x.html]


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, train(spark, weak_sample(pages)))
