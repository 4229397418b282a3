"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements. Two ensembles of regression trees, grown
by gradient boosting on labelled pages, give for each node the chances that its text
is of both kinds, or all article, or all rest. The decoding picks the likeliest
labelling in which everything below an article node is article and everything below
a rest node is rest. Training pages are drawn from a seeded generator of layouts.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
BLOCKS = set("html body div section article main aside nav header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption address details summary dialog hgroup menu center".split())
HIDDEN = set("head script style noscript template iframe svg object canvas select textarea title option button datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

# Tokens of class and id attributes that tell a block's role.
ROLES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "head": "header masthead banner topbar logo branding".split(),
    "foot": "footer copyright legal colophon bottom".split(),
    "side": "sidebar aside related widget rail recommended trending popular".split(),
    "note": "notice cookie cookies consent alert gdpr popup modal overlay banner warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "form": "form login signup subscribe newsletter search contact".split(),
    "talk": "comment comments reply replies respond discussion disqus thread".split(),
    "share": "share sharing social follow tags meta byline".split(),
    "text": "content article post entry main body story text page".split(),
}
TAGS = ("p", "h", "list", "li", "div", "nav", "header", "footer", "aside", "article", "main", "form", "table", "quote", "body")
_TAG_OF = {f"h{i}": "h" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "section": "div", "fieldset": "form", "blockquote": "quote", "pre": "quote", "tr": "table", "td": "table", "th": "table", "tbody": "table"}
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
#: What follows a tag's name: no part of it is looked at twice. A quote without its second one stands for itself.
_REST = re.compile(r"""((?>[^"'>]+|"[^"]*"|'[^']*'|["'])*+)>""")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ENDS = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_SPLIT = re.compile(r"[^a-z]+")
_ROLE_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(ROLES.values()):
    for _w in _words:
        _ROLE_OF.setdefault(_w, []).append(_i)


#: Slots that attribute tokens outside the lists are hashed to.
SLOTS = 32


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    roles: int = 0
    #: Slots of the attribute tokens outside ROLES, and their number.
    slots: int = 0
    others: int = 0
    children: list[int] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    marks: int = 0
    inputs: int = 0
    at: int = 0


@dataclass
class Page:
    nodes: list[Node]
    #: (node, text) in page order; None marks the border of a block.
    runs: list[tuple[int, str] | None]


def _tokens(attrs: str) -> tuple[int, int, int]:
    """Roles of the tokens in class, id and role; slots of the other tokens; their number."""
    roles, slots, others = 0, 0, 0
    for m in _ATTR.finditer(attrs):
        for word in filter(None, _SPLIT.split((m[1] or m[2] or m[3] or "").lower())):
            for i in _ROLE_OF.get(word, ()):
                roles |= 1 << i
            if word not in _ROLE_OF:
                slots |= 1 << zlib.crc32(word.encode()) % SLOTS
                others += 1
    return roles, slots, others


class Tags:
    """The tags of a page, one after another, in time proportional to its length.

    A tag ends at the first > outside closed quotes. On a page where some tag has none, quotes
    count no more from there on and the next > ends it; where no > follows, all is text.
    """

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last, self.last_cdata = source.rfind(">"), source.rfind("]]>")

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag from pos on; comments and declarations have no name."""
        source = self.source
        while (at := source.find("<", pos)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(source), "", False, ""
            if at > self.last:
                return None
            if source.startswith("<![CDATA[", at) and at < self.last_cdata:
                return at, source.index("]]>", at) + 3, "", False, ""
            if source[at + 1 : at + 2] in ("!", "?"):
                return at, source.index(">", at) + 1, "", False, ""
            name = _NAME.match(source, at + 1)
            if name:
                rest = _REST.match(source, name.end()) if self.quotes else None
                if not rest:
                    self.quotes = False
                    end = source.index(">", name.end())
                    return at, end + 1, name[1].lower(), source[at + 1] == "/", source[name.end() : end]
                return at, rest.end(), name[1].lower(), source[at + 1] == "/", rest[1]
            pos = at + 1
        return None


def parse(source: str) -> Page:
    """Block elements of a page and its visible text. Never fails: what is no tag is text."""
    page = Page([Node("body", -1, 0)], [])
    stack: list[tuple[str, int]] = []  # open elements and the block node they are in
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    hidden, links, pos, total = 0, 0, 0, 0
    nodes, runs, tags = page.nodes, page.runs, Tags(source)

    def text(raw: str) -> None:
        nonlocal total
        if hidden or not raw:
            return
        plain = html.unescape(raw) if "&" in raw else raw
        at = stack[-1][1] if stack else 0
        runs.append((at, plain))
        size = len(plain.split()) and len(plain.strip())
        node = nodes[at]
        node.chars += size
        node.linked += size if links else 0
        node.marks += plain.count(".") + plain.count(",")
        total += size

    def nearest(names) -> int:
        return max((at[-1] for n in names if (at := places.get(n))), default=-1)

    def close(names, scope=()) -> None:
        nonlocal hidden, links
        to = nearest(names)
        if to < 0 or to < nearest(scope):
            return
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCKS and not hidden:
                runs.append(None)

    size = len(source)
    while pos < size:
        found = tags.next(pos)
        if not found:
            text(source[pos:])
            break
        start, end, tag, closing, attrs = found
        text(source[pos:start])
        pos = end
        if not tag:
            continue
        if closing:
            close((tag,), ("table",) if tag not in ("table", "body", "html") else ())
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            elif tag == "input":
                nodes[stack[-1][1] if stack else 0].inputs += 1
            continue
        if tag in CLOSES_P:
            close(("p",), ("button", "table"))
        if tag in PEERS:
            close(PEERS[tag], SCOPES[tag])
        if tag in RAW:
            raw = _ENDS[tag].search(source, pos)
            pos = source.find(">", raw.start() if raw else size) + 1 or size
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        at = stack[-1][1] if stack else 0
        if tag in BLOCKS and tag not in ("html", "body") and not hidden:
            node = Node(tag, at, nodes[at].depth + 1, *(_tokens(attrs) if attrs else (0, 0, 0)), at=total)
            nodes[at].children.append(len(nodes))
            at = len(nodes)
            nodes.append(node)
            runs.append(None)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, at))
        hidden += tag in HIDDEN
        links += tag == "a"
    return page


N_ROLES = len(ROLES)


def features(page: Page) -> np.ndarray:
    """A row for each node: own tag and attribute tokens, those above and below, subtree density, place and siblings."""
    nodes = page.nodes
    n = len(nodes)
    chars, linked = [x.chars for x in nodes], [x.linked for x in nodes]
    marks, inputs, blocks, below = [x.marks for x in nodes], [x.inputs for x in nodes], [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        inputs[p] += inputs[i]
        blocks[p] += blocks[i]
        below[p] |= below[i] | nodes[i].roles
    whole = max(chars[0], 1)
    above, tags_above, own_tag = [0] * n, [0] * n, [0] * n
    near_of = [sum(chars[k] for k in x.children) for x in nodes]
    tags_of = [Counter(nodes[k].tag for k in x.children) for x in nodes]
    rows = []
    for i, x in enumerate(nodes):
        own_tag[i] = TAGS.index(t) if (t := _TAG_OF.get(x.tag, x.tag)) in TAGS else TAGS.index("div")
        p = x.parent
        if p >= 0:
            above[i] = above[p] | nodes[p].roles
            tags_above[i] = tags_above[p] | 1 << own_tag[p]
        kin = len(nodes[p].children) if p >= 0 else 1
        near = near_of[p] if p >= 0 else chars[i]
        alike = tags_of[p][x.tag] / kin if p >= 0 else 1.0
        rows.append((x.depth, own_tag[i], x.roles, above[i], tags_above[i], chars[i], linked[i] / max(chars[i], 1), blocks[i], chars[i] / blocks[i], 100 * marks[i] / max(chars[i], 1), inputs[i], chars[i] / whole, x.at / whole, kin, near / kin, chars[i] / max(near, 1), alike, x.chars, x.others, linked[p] / max(chars[p], 1) if p >= 0 else 0.0, marks[0], below[i], x.slots))
    raw = np.array(rows, dtype=np.float64)
    bits = lambda col, count: (raw[:, col].astype(np.int64)[:, None] >> np.arange(count)) & 1
    one = raw[:, 1].astype(np.int64)[:, None] == np.arange(len(TAGS))
    return np.hstack([raw[:, :1], one, bits(2, N_ROLES), bits(3, N_ROLES), bits(4, len(TAGS)), bits(raw.shape[1] - 2, N_ROLES), bits(raw.shape[1] - 1, SLOTS), raw[:, 5:-2]]).astype(np.float32)


@dataclass
class Trees:
    """Regression trees of one depth, as complete binary trees in arrays."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = self.feature.shape[1].bit_length()
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaves.

    A level's histograms are made for all nodes and features at once: of columns of 0 and 1 from
    the places of the ones, of the others over their bins.
    """
    n = len(x)
    # (feature, cut) of every candidate: first those of the flags, then those of the other columns, a row of cuts each
    is_flag = ((x == 0) | (x == 1)).all(0)
    flags, wide = np.flatnonzero(is_flag), np.flatnonzero(~is_flag)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in wide]
    on_row, on_flag = np.nonzero(x[:, flags])
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in zip(wide, edges, strict=True)], axis=1) + np.arange(len(wide)) * bins
    cuts = np.full((len(wide), bins), np.inf)
    for k, e in enumerate(edges):
        cuts[k, : len(e)] = e
    feature_of = np.concatenate([flags, np.repeat(wide, bins)])
    cut_of = np.concatenate([np.zeros(len(flags)), cuts.ravel()])
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    out = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)

    def left_sums(weight: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weight at or below each candidate's cut, and of all, by node."""
        every = np.bincount(slot, weight, width)[:, None]
        on = np.bincount(slot[on_row] * len(flags) + on_flag, weight[on_row], width * len(flags)).reshape(width, -1)
        keys = (slot * (len(wide) * bins))[:, None] + binned
        sums = np.bincount(keys.ravel(), np.repeat(weight, len(wide)), width * len(wide) * bins).reshape(width, len(wide), bins)
        return np.hstack([every - on, sums.cumsum(2).reshape(width, -1)]), every

    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            gl, ga = left_sums(g, at - first, width)
            hl, ha = left_sums(h, at - first, width)
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[:, np.isinf(cut_of)] = 0
            where = gain.argmax(1)
            found = np.flatnonzero(gain[np.arange(width), where] > 1e-6)
            out.feature[t, first + found] = feature_of[where[found]]
            out.cut[t, first + found] = cut_of[where[found]]
            f, c = out.feature[t, at], out.cut[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > c)
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        out.leaf[t] = -rate * gs / (hs + ridge)
        score += out.leaf[t][leaf]
    return out


@dataclass
class Model:
    mixed: Trees
    article: Trees


def decode(page: Page, mixed: np.ndarray, article: np.ndarray) -> list[bool]:
    """For each node whether its own text is article: the likeliest labelling without contradictions."""
    tiny = 1e-6
    both = np.log(mixed + tiny)
    good = np.log(1 - mixed + tiny) + np.log(article + tiny)
    rest = np.log(1 - mixed + tiny) + np.log(1 - article + tiny)
    nodes = page.nodes
    n = len(nodes)
    all_good, all_rest, free = good.tolist(), rest.tolist(), both.tolist()
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        if not nodes[i].children:
            free[i] = -1e9
        best[i] = max(all_good[i], all_rest[i], free[i])
        p = nodes[i].parent
        if p >= 0:
            all_good[p] += all_good[i]
            all_rest[p] += all_rest[i]
            free[p] += best[i]
    label = [""] * n
    for i in range(n):
        p = nodes[i].parent
        above = label[p] if p >= 0 else "mixed"
        if above != "mixed":
            label[i] = above
        elif all_good[i] == best[i]:
            label[i] = "article"
        else:
            label[i] = "rest" if all_rest[i] == best[i] else "mixed"
    # what stands in a mixed node itself goes with the likelier kind of its own
    return [x == "article" or x == "mixed" and good[i] > rest[i] for i, x in enumerate(label)]


def render(page: Page, keep: list[bool]) -> str:
    """Blocks of the kept nodes' text in page order, one a line."""
    blocks, now = [], []
    for run in [*page.runs, None]:
        if run is None:
            line = " ".join("".join(now).split())
            if line:
                blocks.append(line)
            now = []
        elif keep[run[0]]:
            now.append(run[1])
    return "\n".join(blocks)


def extract(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    tables = [features(p) for p in pages]
    if not tables:
        return []
    x = np.concatenate(tables)
    mixed, article = model.mixed.predict(x), model.article.predict(x)
    ends = np.cumsum([len(t) for t in tables])
    return [render(p, decode(p, mixed[e - len(t) : e], article[e - len(t) : e])) for p, t, e in zip(pages, tables, ends, strict=True)]


class Layouts:
    """Labelled pages: text of the article is marked with a leading sign, which parse's caller takes off."""

    SIGN = "\x01"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, n: int, stops: bool = True) -> str:
        r = self.rng
        out = ["".join(r.choices("aeiounrstlmdéü", k=r.randint(1, 9))) for _ in range(n)]
        if stops:
            out = [w + (r.choice(".,.;") if r.random() < 0.15 else "") for w in out]
        return " ".join(out)

    def attrs(self, role: str | None) -> str:
        r = self.rng
        if role is None or r.random() < 0.15:
            return r.choice(["", "", f' class="{self.words(1, False)}"', f' id="x{r.randint(1, 99)}"'])
        word = r.choice(ROLES[role])
        name = r.choice([word, f"{word}-{self.words(1, False)}", f"{self.words(1, False)} {word}", f"site-{word}", f"{word}_{r.randint(1, 9)}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def topic(self) -> str:
        """Attributes of a part of the article: a name of several words, which may be those of a role."""
        r = self.rng
        if r.random() < 0.5:
            return r.choice(["", f' class="{self.words(1, False)}"', f' class="{r.choice(ROLES["text"])}"'])
        words = [self.words(1, False) for _ in range(r.randint(2, 3))]
        if r.random() < 0.7:
            words[r.randrange(len(words) - 1)] = r.choice([w for k, of in ROLES.items() if k != "text" for w in of])
        return f' {r.choice(["class", "id"])}="{"-".join(words)}"'

    def linked(self, text: str) -> str:
        """A text with a link around it all or around some of its words."""
        r, words = self.rng, text.removeprefix(self.SIGN).split(" ")
        i = 0 if r.random() < 0.5 else r.randrange(len(words))
        j = len(words) if i == 0 else r.randint(i + 1, min(len(words), i + 4))
        piece = lambda part: self.SIGN + " ".join(part) if part else ""
        return f'{piece(words[:i])} <a href="/{self.words(1, False)}">{piece(words[i:j])}</a> {piece(words[j:])}'

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.words(1, False)}">{self.words(self.rng.randint(1, 4), False)}</a>'
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(item() for _ in range(n))

    def rest(self, role: str) -> str:
        r = self.rng
        tag = {"nav": ["nav", "div", "ul"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "div", "section"], "note": ["div", "section", "p"], "ad": ["div", "aside", "p"], "form": ["form", "div"], "talk": ["section", "div"], "share": ["div", "p", "ul"]}[role]
        tag = r.choice(tag)
        body = {
            "nav": lambda: self.links(r.choice([1, 2, 3, r.randint(2, 12), r.randint(2, 12)])),
            "head": lambda: f"<h1>{self.words(r.randint(1, 6), False)}</h1>" * (r.random() < 0.4) + f"<p>{self.words(r.randint(2, 12))}</p>",
            "foot": lambda: f"&copy; {self.words(r.randint(3, 30))}" + self.links(r.randint(1, 6)) * (r.random() < 0.4),
            "side": lambda: f"<h3>{self.words(r.randint(1, 4), False)}</h3>" + r.choice([self.links(r.randint(2, 8)), f"<p>{self.words(r.randint(8, 60))}</p>"]),
            "note": lambda: self.words(r.randint(5, 40)),
            "ad": lambda: self.words(r.randint(3, 40)),
            "form": lambda: f"<label>{self.words(2, False)}</label><input type=text>{self.words(r.randint(1, 20))}<input type=submit><button>ok</button>",
            "talk": lambda: f"<h3>{self.words(2, False)}</h3>" + "".join(f'<{t}{self.attrs("talk")}>' + f"<p>{self.words(r.randint(4, 60))}</p></{t}>" for t in [r.choice(["div", "article", "li"])] for _ in range(r.randint(1, 8))),
            "share": lambda: self.links(r.randint(2, 5)),
        }[role]()
        if tag in ("p", "ul") and "<" in body:
            tag = "div"
        # a paragraph tells its role by its name alone
        attrs = f' class="{r.choice(ROLES[role])}"' if tag == "p" else self.attrs(role)
        return f"<{tag}{attrs}>{body}</{tag}>"

    def part(self, text: str) -> str:
        """One block of an article."""
        kind, r = self.rng.random(), self.rng
        if r.random() < 0.1:
            text = self.linked(text)
        if kind < 0.1:
            head = self.SIGN + self.words(3, False)
            return f"<h2>{self.linked(head) if r.random() < 0.2 else head}</h2>"
        if kind < 0.16:
            items = [self.SIGN + self.words(r.randint(2, 14)) for _ in range(r.randint(1, 6))]
            if r.random() < 0.25:
                items = [self.linked(i) for i in items]
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if kind < 0.2:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.26:
            return f"<p><b>{text}<br>"
        if kind < 0.34:
            inner = text if r.random() < 0.5 else "".join(f"<p>{self.SIGN}{self.words(r.randint(20, 90))}</p>" for _ in range(r.randint(1, 3)))
            return f"<{(tag := r.choice(['div', 'div', 'section']))}{self.topic()}>{inner}</{tag}>"
        if kind < 0.36:
            return f"<table><tr><td>{text}</td><td>{self.SIGN}{self.words(3)}</td></tr></table>"
        return f"<p{self.topic() if r.random() < 0.05 else ''}>{text}</p>"

    def article(self, few: bool = False) -> str:
        """An article; few: of one to three blocks."""
        r = self.rng
        head = self.SIGN + self.words(r.randint(2, 9), False)
        parts = [f"<h1>{self.linked(head) if r.random() < 0.1 else head}</h1>"] if r.random() < (0.4 if few else 0.8) else []
        short = r.random() < 0.12 and not few
        for _ in range(r.randint(1, 3) if few else r.randint(0, 1) if short else r.randint(1, 14)):
            text = self.SIGN + self.words(r.choice([1, 3, 6] if short else [3, 6, 12, 20, 60] if few else [2, 8, 20, 60, 120]))
            parts.append(f"<p>{self.linked(text) if r.random() < 0.15 else text}</p>" if few and r.random() < 0.5 else self.part(text))
            if r.random() < 0.12:
                parts.append(self.rest(r.choice(["ad", "share", "note", "form", "side"])))
        if r.random() < 0.15:
            parts.append(self.rest("talk"))
        tag, role = r.choice([("article", None), ("article", "text"), ("div", "text"), ("main", "text"), ("section", "text"), ("main", None)])
        return f"<{tag}{self.attrs(role)}>{''.join(parts)}</{tag}>"

    def bare(self) -> str:
        """A page that is nearly all article: no wrapper or little around it."""
        r = self.rng
        head, body = self.SIGN + self.words(r.randint(1, 8), False), self.article(few=r.random() < 0.7)
        if r.random() < 0.4:
            body = f"<h1>{head}</h1>" * (r.random() < 0.4) + "".join(f"<p>{self.SIGN}{self.words(r.choice([6, 12, 20, 60]))}</p>" for _ in range(r.choice([1, 1, 2, 4])))
        around = [self.rest(k) if r.random() < 0.3 else "" for k in ("nav", "ad", "foot")]
        return f"<html><body>{around[0]}{around[1]}{body}{around[2]}</body></html>"

    def empty(self) -> str:
        """A page without an article."""
        return "<html><body>" + "".join(self.rest(k) for k in ROLES if k != "text" and self.rng.random() < 0.25) + "</body></html>"

    def page(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.22:
            return self.bare() if kind < 0.16 else self.empty()
        before = [self.rest(k) for k in ("nav", "head", "note", "ad", "form", "side") if r.random() < 0.5]
        after = [self.rest(k) for k in ("talk", "side", "share", "form", "ad", "nav", "foot") if r.random() < 0.5]
        r.shuffle(before)
        middle = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.4:
            keep = r.randint(0, len(after))
            middle = f'<div{self.attrs(r.choice(["text", None]))}>{middle}{"".join(after[:keep])}</div>'
            after = after[keep:]
        return f"<html><head><title>{self.words(4)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def train(pages: int = 1500, seed: int = 7) -> Model:
    """Fit both ensembles on generated pages; pages and seed fix the result."""
    layouts = Layouts(seed)
    x, mixed, pure = [], [], []
    for _ in range(pages):
        page = parse(layouts.page())
        own = np.zeros((len(page.nodes), 2))
        for run in filter(None, page.runs):
            own[run[0], int(layouts.SIGN in run[1])] += len(run[1].strip())
        for i in range(len(page.nodes) - 1, 0, -1):
            own[page.nodes[i].parent] += own[i]
        used = own.sum(1) > 0
        x.append(features(page)[used])
        mixed.append((own.min(1) > 0)[used])
        pure.append((own[:, 1] > own[:, 0])[used])
    x, mixed, pure = np.concatenate(x), np.concatenate(mixed), np.concatenate(pure)
    return Model(boost(x, mixed.astype(float)), boost(x[~mixed], pure[~mixed].astype(float)))


_models: dict[tuple, Model] = {}


def default_model(pages: int = 1500, seed: int = 7) -> Model:
    if (pages, seed) not in _models:
        _models[pages, seed] = train(pages, seed)
    return _models[pages, seed]


def main_text(pages: DataFrame, text_col: str = "html", model: Model | None = None, rows: int = 128) -> DataFrame:
    """pages with text: the main text of each, empty if there is none (null or empty html too).

    The whole page is read, however long. Other columns stay as they are; a column named text
    is replaced. Repeated rows each get theirs; an empty table gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    at, names = pages.columns.index(text_col), [f"c{i}" for i in range(len(pages.columns))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = extract([s or "" for s in part.column(at).to_pylist()], own)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "made"])

    plain = pages.toDF(*names)
    made = plain.mapInArrow(task, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", made string")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(pages.columns) if c != "text"]
    return made.select(*kept, F.col("made").alias("text"))
