"""Text of markup pages in one pass with a stack of open elements (A10).

The tokenizer is that of Python's standard library (tags, attributes in quotes, comments, raw
text of scripts and styles, all named and numeric character references). This module keeps the stack:

* Text inside an element that holds none (``DROP_ELEMENTS``) is left out, at any depth. Such an element that is never
  closed ends with the element around it; a script or style that is never closed goes to the end of the page.
* An end tag closes the elements opened since its start tag; without a start tag it closes nothing. Elements
  that their next sibling closes (``SIBLINGS``) do, and the body closes the head.
* Tags that start or end a block break the line; other tags and comments vanish.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements whose content is not text, tags that end a text block, elements without an
# end tag, and elements that a sibling of the same group closes.
DROP_ELEMENTS = ["script", "style", "nav", "head", "noscript"]
BLOCK_TAGS = ["p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "article",
              "section", "header", "footer", "table", "tr", "td", "th", "blockquote", "pre",
              "main", "aside", "figure", "figcaption", "hr", "title", "body", "html"]
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SIBLINGS = [["p"], ["li"], ["dt", "dd"], ["tr"], ["td", "th"], ["option"]]

_DROP, _BLOCK, _VOID = set(DROP_ELEMENTS), set(BLOCK_TAGS), set(VOID_ELEMENTS)
_GROUP = {t: frozenset(g) for g in SIBLINGS for t in g}
#: Elements that a sibling's start does not reach out of.
_BARRIER = {"table", "ul", "ol", "dl", "select", "div", "body", "html", "td", "th"}
_EDGE = re.compile(r"^[ \t\r]+|[ \t\r]+\Z")


class PageText(HTMLParser):
    """Feeds on one page; ``text`` is its body text with a newline at each block, ``title`` the text of
    its first title element (None if there is none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped = 0  # open elements that hold no text
        self.parts: list[str] = []
        self.title_parts: list[str] | None = None
        self.in_title = False

    def _pop(self, keep: int) -> None:
        for t in self.open[keep:]:
            self.dropped -= t in _DROP
            self.in_title = self.in_title and t != "title"
        del self.open[keep:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body" and "head" in self.open:
            self._pop(self.open.index("head"))
        group = _GROUP.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in group:
                self._pop(i)
                break
            if self.open[i] in _BARRIER:
                break
        if tag in _BLOCK and not self.dropped:
            self.parts.append("\n")
        if tag in _VOID:
            return
        self.open.append(tag)
        self.dropped += tag in _DROP
        if tag == "title" and self.title_parts is None:
            self.title_parts, self.in_title = [], True

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash before the end means nothing in a start tag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._pop(len(self.open) - 1 - self.open[::-1].index(tag))
        if tag in _BLOCK and not self.dropped:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title_parts.append(data)
        if not self.dropped:
            self.parts.append(data)


def page_text(html: str) -> tuple[str, list[str]]:
    """(title, text lines) of a page: lines without blanks at their ends, empty lines left out. A non-breaking
    space is a space."""
    p = PageText()
    p.feed(html)
    p.close()
    title = "".join(p.title_parts or []).replace("\xa0", " ")
    lines = (_EDGE.sub("", t) for t in "".join(p.parts).replace("\xa0", " ").split("\n"))
    return _EDGE.sub("", title), [t for t in lines if t]
