"""Pages that never close what they open, and pages with many names."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from moorage.llm import htmltext


def plainly(html):
    """The nodes as the parser makes them of the whole page at once."""
    builder = htmltext._Builder()
    HTMLParser.feed(builder, html)
    HTMLParser.close(builder)
    return [(n.tag, n.parent, n.names, " ".join("".join(n.parts).split())) for n in builder.nodes]


ODD = [
    "a<!-- more <b>x</b> y", "a <p class='x' y z", "a <p> t <c d", "x < y and z &lt; &amp", "a</p c", "a<!doctype x", "a<?pi x",
    "t<script>var a='<p>'", "a<p>c<!-- x --> d <!-- e", "a <title>x <b", "<style> x", "x<!-- a --!> b<p>c", "x<",
    "a <b<c<d e", "<p>one<!-- two <p>three</p> <!-- four> five", "<!-- done --><p>x <!--&amp;> y &amp; z", "<p>a<!-->b<!--->c", "",
]


@pytest.mark.parametrize("html", ODD)
def test_what_never_closes_is_text(html):
    found = [(n.tag, n.parent, n.names, n.parts[0] if n.parts else "") for n in htmltext.parse(html)]
    assert found == plainly(html)


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "<!-- x> ", "</a ", "<a b='", "<p>x", "<!x "])
def test_a_megabyte_takes_seconds(piece):
    began = time.monotonic()
    htmltext.parse("<p>start</p>" + piece * (1_000_000 // len(piece)))
    assert time.monotonic() - began < 10


def test_every_name_counts():
    names = " ".join(f"u{i}" for i in range(40))
    node = htmltext.parse(f'<div class="{names} comments">text</div>')[1]
    assert "name comments" in htmltext.features(node, [])
