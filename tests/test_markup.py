"""Pages that a chain of patterns gets wrong, one rule each."""

import pytest

from lexiforge.sources.markup import page_text
from lexiforge.sources.text import extract_pages

PAGES = {
    "attribute holds >": ('<p title="a > b">x</p>', ["x"]),
    "less-than in a text": ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
    "unclosed script": ("<p>a</p><script>var x = 1;", ["a"]),
    "script that writes tags": ("<script>document.write('<p>no</p>');</script><p>yes</p>", ["yes"]),
    "nested dropped elements": ("<nav>a<nav>b</nav>c</nav><p>d</p>", ["d"]),
    "unclosed nav ends with its parent": ("<div><nav>menu<ul><li>one</div><p>text</p>", ["text"]),
    "end tag without a start": ("<p>a</nav>b</p></div>c", ["ab", "c"]),
    "head closed by the body": ("<head><title>t</title><meta x><body>b", ["b"]),
    "numeric and named references": ("<p>caf&eacute; &#8211; &#x4E2D; &hearts;</p>", ["café – 中 ♥"]),
    "reference of a reference": ("<p>&amp;lt;b&amp;gt;</p>", ["&lt;b&gt;"]),
    "comment holds a tag": ("a<!-- <p> x > y </p> -->b", ["ab"]),
    "unclosed paragraphs": ("<p>a<p>b<p>c", ["a", "b", "c"]),
    "list items without end": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    "table cells": ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    "inline tags vanish": ("<p>a<b>b</b><i>c</i></p>", ["abc"]),
    "upper case": ("<DIV>a<SCRIPT>x</SCRIPT></DIV><P>b", ["a", "b"]),
    "blanks and lines": ("  a \t\n\n  b\xa0\r\n", ["a", "b"]),
    "slash in a start tag": ("<script/>x</script><br/>a<hr/>b", ["a", "b"]),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_of_page(name):
    html, want = PAGES[name]
    assert page_text(html)[1] == want


def test_titles():
    assert page_text("<title> A &amp; B </title><title>no</title><p>x")[0] == "A & B"
    assert page_text("<p>x")[0] == "" and page_text("<title>open")[0] == "open"


def test_deep_page_ends():
    assert page_text("<div>" * 20_000 + "x" + "</div>" * 20_000)[1] == ["x"]


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<title>T</title><p>a"), (2, "v", None), (3, "w", "")], "page_id long, url string, html string")
    got = [(r.part, r.line_no, r.line) for r in extract_pages(pages).orderBy("part", "line_no").collect()]
    assert got == [(1, 0, '<doc id="1" url="u" title="T">'), (1, 1, "T"), (1, 2, ""), (1, 3, "T"), (1, 4, "a"), (1, 5, "</doc>"),
                   (3, 0, '<doc id="3" url="w" title="">'), (3, 1, ""), (3, 2, ""), (3, 3, "</doc>")]
