"""Main text of web pages from a tree-structured model over DOM nodes."""

from __future__ import annotations

import math
import random
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

# Elements of the HTML standard, by how they take part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe object svg canvas math audio video map "
    "select option optgroup datalist textarea button output progress meter".split()
)
# An opening tag on the left ends an open element on the right, up to the stated limits.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS |= {"tbody": {"tbody", "thead"}, "tfoot": {"tbody", "thead"}}
_LIMITS = frozenset("ul ol dl table html body article section div".split())
_NAMES = regex.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
_OPENED = regex.compile(r"<!--[^>]*>")
_HIDDEN = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", regex.I)
LEAF = "#text"
# Exponents of potentials. Leaves of one element resemble each other, so each counts less
# than it would alone; the names that a site gives to its parts are set on purpose.
WEIGHTS = {"leaf": 0.3, "block": 1.0, "tag": 1.0, "name": 2.0}


class Node:
    """A block element, or a run of text between block borders (``LEAF``)."""

    __slots__ = ("tag", "parent", "names", "parts", "chars", "linked", "links")

    def __init__(self, tag: str, parent: int, names: list[str]):
        self.tag, self.parent, self.names = tag, parent, names
        self.parts: list[str] = []
        self.chars = self.linked = self.links = 0


class _Builder(HTMLParser):
    """Block tree of a page; parents stand before children, leaves in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, [])]
        self.open: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, node, unseen
        self.counts: dict[str, int] = {"html": 1}
        self.leaf: Node | None = None
        self.anchors = 0

    def _pop(self) -> None:
        tag, _, _ = self.open.pop()
        self.counts[tag] -= 1
        if tag == "a":
            self.anchors -= 1
        if tag in BLOCKS:
            self.leaf = None

    def _close(self, tags: set[str], limits: frozenset) -> None:
        if not any(self.counts.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in tags:
                while len(self.open) > at:
                    self._pop()
                return
            if self.open[at][0] in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.leaf = None
            self._close({"p"}, frozenset({"table", "td", "th"}))
            if tag in _ENDS:
                self._close(_ENDS[tag], _LIMITS - _ENDS[tag] - {tag})
        if tag in VOIDS:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in ("html", "body") and self.counts.get(tag):
            return
        _, node, unseen = self.open[-1]
        values = dict(attrs)
        if not unseen:
            unseen = (
                tag in UNSEEN
                or "hidden" in values
                or values.get("aria-hidden") == "true"
                or bool(_HIDDEN.search(values.get("style") or ""))
            )
        if tag in BLOCKS and not unseen:
            words = " ".join(values.get(a) or "" for a in ("class", "id", "role", "itemprop"))
            names = [n.lower() for n in _NAMES.findall(words)]
            self.nodes.append(Node(tag, node, names))
            node = len(self.nodes) - 1
        if tag == "a":
            self.anchors += 1
            if self.leaf is not None:
                self.leaf.links += 1
        self.open.append((tag, node, unseen))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOIDS and tag not in BLOCKS and self.open[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.leaf = None
        if tag in ("html", "body"):
            return
        self._close({tag}, frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data):
        _, node, unseen = self.open[-1]
        if unseen:
            return
        if self.leaf is None:
            if not data.strip():
                return
            self.leaf = Node(LEAF, node, [])
            self.leaf.links = 1 if self.anchors else 0
            self.nodes.append(self.leaf)
        self.leaf.parts.append(data)
        if self.anchors:
            self.leaf.linked += len(data)


def _closing(html: str) -> tuple[str, str]:
    """A page as far as tags can end, and the text behind.

    Where nothing closes a comment any more, its opening is text up to the next ``>``. Told in
    advance, the parser does not look through the rest of the page for every such opening.
    """
    end = html.rfind(">") + 1
    closed, rest = html[:end], html[end:]
    last = closed.rfind("-->")
    begin = last + 3 if last >= 0 else 0
    # Every opening has a ">" behind it here, so each part is looked at once.
    closed = closed[:begin] + _OPENED.sub(lambda m: m[0].replace("<", "&lt;"), closed[begin:])
    return closed, rest


def parse(html: str) -> list[Node]:
    builder = _Builder()
    closed, rest = _closing(html)
    builder.feed(closed)
    builder.close()
    if rest:
        builder.handle_data(rest if builder.cdata_elem else unescape(rest))
    nodes = builder.nodes
    for node in nodes:
        if node.tag == LEAF:
            raw = sum(map(len, node.parts))
            node.parts = [" ".join("".join(node.parts).split())]
            node.chars = len(node.parts[0])
            node.linked = round(node.linked * node.chars / max(1, raw))
    for node in reversed(nodes):
        if node.parent >= 0:
            up = nodes[node.parent]
            up.chars, up.linked, up.links = up.chars + node.chars, up.linked + node.linked, up.links + node.links
    return nodes


def features(node: Node, nodes: list[Node]) -> list[str]:
    """What a node shows of itself; each is independent of the others given its state."""
    kind = "leaf" if node.tag == LEAF else "block"
    density = 0 if not node.chars else min(4, math.ceil(4 * node.linked / node.chars))
    out = [f"{kind} size {min(9, node.chars.bit_length())}", f"{kind} links {density}"]
    if kind == "leaf":
        text = node.parts[0]
        out.append(f"leaf tag {nodes[node.parent].tag}")
        out.append(f"leaf ends {text[-1:] in ('.', '!', '?', '…', '。', ':', '”', '»')}")
        out.append(f"leaf commas {min(3, text.count(','))}")
        if text[:1] in ("©", "®") or "©" in text[:80]:
            out.append("leaf notice")
    else:
        out.append(f"tag {node.tag}")
        out.extend(f"name {name}" for name in dict.fromkeys(node.names))
    return out


_HOLDERS = frozenset("html body main article section div header footer nav aside form table fieldset".split())


def kind_of(node: Node) -> int:
    """Leaves, holders of other blocks and the rest take part in different potentials."""
    return 0 if node.tag == LEAF else 1 if node.tag in _HOLDERS else 2


class TreeModel:
    """Potentials of a tree of two-state nodes: 1 is a part of the main text."""

    def __init__(self):
        # Counts of child state by kind of child and parent state.
        self.states = [[[0.2, 0.2], [0.2, 0.2]] for _ in range(3)]
        self.roots = [1.0, 1.0]
        self.seen: dict[str, list[float]] = {}
        self.totals = {"leaf": [1.0, 1.0], "block": [1.0, 1.0]}
        self.logs: dict[str, float] = {}
        self.edges = [[[0.5, 0.5], [0.5, 0.5]]] * 3

    def train(self, pages: list[tuple[str, str]]) -> TreeModel:
        """``pages`` are (html, main text): a leaf is main text if its text is a line of it.

        The lowest element that holds all main text is a part of it, and so is every element
        below with more main text than other; elements above or beside are not.
        """
        for html, wanted in pages:
            lines = set(wanted.split("\n"))
            nodes = parse(html)
            good = [n.chars if n.tag == LEAF and n.parts[0] in lines else 0 for n in nodes]
            for at in range(len(nodes) - 1, 0, -1):
                good[nodes[at].parent] += good[at]
            lowest = max(at for at, g in enumerate(good) if g == good[0])
            while nodes[lowest].tag == LEAF or nodes[lowest].tag not in _HOLDERS:
                lowest = nodes[lowest].parent
            state = [0] * len(nodes)
            state[lowest] = int(good[0] > 0)
            self.roots[state[0]] += 1
            for at in range(lowest + 1, len(nodes)):
                inside = state[nodes[at].parent] or nodes[at].parent == lowest
                state[at] = int(inside and 2 * good[at] > nodes[at].chars)
            for at, node in enumerate(nodes):
                if at:
                    self.states[kind_of(node)][state[node.parent]][state[at]] += 1
                self.totals["leaf" if node.tag == LEAF else "block"][state[at]] += 1
                for name in features(node, nodes):
                    self.seen.setdefault(name, [0.0, 0.0])[state[at]] += 1
        self.edges = [[[c / sum(row) for c in row] for row in part] for part in self.states]
        for name, counts in self.seen.items():
            totals = self.totals["leaf" if name.startswith("leaf") else "block"]
            # The smoothing is dealt by the share of each state, so rare features say little.
            share = [t / sum(totals) for t in totals]
            odds = [(c + 2 * s) / (t + 2) for c, t, s in zip(counts, totals, share)]
            self.logs[name] = WEIGHTS[name.split(" ", 1)[0]] * (math.log(odds[1]) - math.log(odds[0]))
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of state 1 for every node, by messages up to the root and down again."""
        own = []
        for node in nodes:
            odds = sum(self.logs.get(name, 0.0) for name in features(node, nodes))
            odds = max(-30.0, min(30.0, odds))
            own.append((1.0, math.exp(odds)) if odds < 0 else (math.exp(-odds), 1.0))
        edges = [self.edges[kind_of(node)] for node in nodes]
        belief = [list(o) for o in own]  # own potential times the messages of children
        upward = [(1.0, 1.0)] * len(nodes)
        for at in range(len(nodes) - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[at]
            b0, b1 = belief[at]
            m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
            total = m0 + m1
            upward[at] = (m0 / total, m1 / total)
            up = belief[nodes[at].parent]
            up[0] *= upward[at][0]
            up[1] *= upward[at][1]
            scale = up[0] + up[1]
            up[0] = max(up[0] / scale, 1e-300)
            up[1] = max(up[1] / scale, 1e-300)
        out = [0.0] * len(nodes)
        belief[0] = [b * p for b, p in zip(belief[0], self.roots)]
        for at in range(1, len(nodes)):
            up, message = belief[nodes[at].parent], upward[at]
            # The parent's belief without what this child told it.
            p0, p1 = up[0] / message[0], up[1] / message[1]
            (e00, e01), (e10, e11) = edges[at]
            b0, b1 = belief[at]
            b0, b1 = b0 * (p0 * e00 + p1 * e10), b1 * (p0 * e01 + p1 * e11)
            total = b0 + b1
            belief[at] = [max(b0 / total, 1e-300), max(b1 / total, 1e-300)]
            out[at] = b1 / total
        return out

    def blocks(self, html: str | None) -> list[tuple[str, float]]:
        """Every text block of a page in order, with its chance to be main text."""
        if not html:
            return []
        nodes = parse(html)
        chances = self.marginals(nodes)
        return [(n.parts[0], c) for n, c in zip(nodes, chances) if n.tag == LEAF and n.parts[0]]

    def main_text(self, html: str | None) -> str:
        return "\n".join(text for text, chance in self.blocks(html) if chance >= 0.5)


# Names that sites commonly give to parts of a page; used to write labelled pages.
ASIDE_NAMES = (
    "nav navbar menu topnav header masthead banner footer bottom copyright legal sidebar aside widget rail "
    "related recommended trending ad ads advert advertisement sponsor sponsored promo cookie consent notice "
    "alert popup modal newsletter subscribe signup login search share social breadcrumb pagination tags "
    "comment comments reply discussion respond disqus toolbar skip contact"
).split()
MAIN_NAMES = "article main content post entry story body text page prose".split()


def labelled_pages(count: int = 1000, seed: int = 5) -> list[tuple[str, str]]:
    """Pages of many layouts, written by rule together with their main text."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def sentence(low: int = 4, high: int = 18) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        words = [w + "," if rng.random() < 0.08 else w for w in words]
        return " ".join(words).capitalize().rstrip(",") + "."

    def short() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 4))).capitalize()

    def name(pool) -> str:
        parts = [rng.choice(pool)] + ([rng.choice(["box", "wrap", "inner", "section", "list", "left", "x"])] if rng.random() < 0.4 else [])
        attribute = rng.choice(["class", "class", "id"])
        return f' {attribute}="{rng.choice(["-", "_"]).join(parts)}"'

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{short()}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>" if rng.random() < 0.7 else items.replace("<li>", " ").replace("</li>", " ")

    def chatter() -> str:
        return " ".join(sentence(2, 14) for _ in range(rng.randint(1, 3)))

    def boilerplate(place: str) -> str:
        tag = {"top": ["nav", "header", "div"], "side": ["aside", "div", "section"], "end": ["footer", "div", "section"]}
        tag = rng.choice(tag[place])
        marks = name(ASIDE_NAMES) if tag in ("div", "section") or rng.random() < 0.5 else ""
        kind, head = rng.random(), rng.choice(["h1", "h2", "h3"])
        if kind < 0.3:
            inner = links(rng.randint(2, 9))
        elif kind < 0.55:
            inner = chatter()
        elif kind < 0.7:
            inner = f"<p>{chatter()}</p>" * rng.randint(1, 3)
        elif kind < 0.82:
            inner = f"<{head}>{short()}</{head}>" + (links(rng.randint(2, 5)) if rng.random() < 0.6 else f"<p>{chatter()}</p>")
        elif kind < 0.9:
            inner = f"&copy; {short()} &middot; {chatter()}"
        else:
            inner = f'<form action="/x"><label>{short()}</label><input name="q"><p>{sentence()}</p></form>'
        return f"<{tag}{marks}>{inner}</{tag}>"

    def comments() -> str:
        each = "".join(
            f'<{t}{name(["comment", "reply", "respond"])}><p>{short()}</p><p>{chatter()}</p></{t}>'
            for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4)
        )
        tag = rng.choice(["section", "div", "aside"])
        return f'<{tag}{name(["comments", "discussion", "comment", "respond"])}><h2>{short()}</h2>{each}</{tag}>'

    pages = []
    for _ in range(count):
        lines: list[str] = []

        def block(tag: str, text: str) -> str:
            plain = " ".join(text.split())
            lines.append(plain)
            roll = rng.random()
            shown = plain.replace("&", "&amp;")
            if roll < 0.15 and len(plain.split()) > 3:
                head, tail = shown.split(" ", 1)
                shown = f"{head} <a href='/{word()}'>{tail.split(' ', 1)[0]}</a> {tail.split(' ', 1)[-1]}" if " " in tail else shown
                if " " in tail:
                    lines[-1] = plain
            elif roll < 0.3:
                shown = f"<b>{shown}</b>"
            return f"<{tag}>{shown}</{tag}>"

        body = []
        if rng.random() < 0.8:
            body.append(block(rng.choice(["h1", "h1", "h2"]), sentence(2, 10).rstrip(".") if rng.random() < 0.5 else sentence(2, 10)))
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            roll = rng.random()
            if roll < 0.72:
                body.append(block("p", " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8, 16])))))
            elif roll < 0.8:
                body.append(block(rng.choice(["h2", "h3"]), short()))
            elif roll < 0.88:
                items = "".join(block("li", sentence(1, 12)) for _ in range(rng.randint(2, 5)))
                body.append(f"<ul>{items}</ul>")
            elif roll < 0.93:
                body.append(f"<blockquote>{block('p', sentence())}</blockquote>")
            elif roll < 0.96:
                body.append("<table><tr>" + "".join(block("td", short()) for _ in range(3)) + "</tr></table>")
            else:
                body.append(boilerplate("side"))
        tag = rng.choice(["article", "article", "main", "div", "section"])
        marks = name(MAIN_NAMES) if tag in ("div", "section") or rng.random() < 0.4 else ""
        main = f"<{tag}{marks}>{''.join(body)}</{tag}>"
        if rng.random() < 0.3:
            main = f"<{rng.choice(['main', 'div'])}{name(MAIN_NAMES)}>{main}{comments() if rng.random() < 0.4 else ''}</div>"
        parts = [boilerplate("top") for _ in range(rng.randint(0, 3))]
        parts += [boilerplate("side") for _ in range(rng.randint(0, 2))]
        parts.append(main)
        if rng.random() < 0.3:
            parts.append(comments())
        parts += [boilerplate("side") for _ in range(rng.randint(0, 2))]
        parts += [boilerplate("end") for _ in range(rng.randint(0, 2))]
        whole = "".join(parts)
        if rng.random() < 0.2:
            whole = f"<div{name(['page', 'wrap', 'container', 'site'])}>{whole}</div>"
        if rng.random() < 0.06:  # a fragment without any frame
            whole = "".join(body)
        else:
            whole = f"<html><head><title>{short()}</title></head><body>{whole}</body></html>"
        pages.append((whole, "\n".join(lines)))
    return pages


def extract(
    pages: DataFrame,
    model: TreeModel | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(key, url, text, n_chars, n_blocks): the main text of every page row.

    Blocks whose marginal is at least one half are kept, in page order, joined by a line
    feed; white space inside a block is one space. ``n_blocks`` counts all text blocks. NULL
    and empty pages, and those without a main block, give the empty text. Repeated rows
    stay; further columns are left out. ``model`` defaults to one trained on
    ``labelled_pages``; its size does not depend on the data.
    """
    model = model or TreeModel().train(labelled_pages())
    edges, logs, roots = model.edges, model.logs, model.roots
    schema = pages.schema
    kinds = [schema[c].dataType.simpleString() for c in (key, url)]

    def run(batch):
        held = TreeModel()
        held.edges, held.logs, held.roots = edges, logs, roots
        texts, counts = [], []
        for value in batch.column(2).to_pylist():
            found = held.blocks(value)
            texts.append("\n".join(text for text, chance in found if chance >= 0.5))
            counts.append(len(found))
        return {
            key: batch.column(0),
            url: batch.column(1),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "n_blocks": pa.array(counts, pa.int64()),
        }

    return map_rows(
        pages.select(F.col(key), F.col(url), F.col(html)),
        run,
        f"{key} {kinds[0]}, {url} {kinds[1]}, text string, n_chars bigint, n_blocks bigint",
        html,
    )
