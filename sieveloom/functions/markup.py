"""Documents as trees, as far as the rules on running text need them.

``html.parser`` with implied end tags (paragraphs, list items and terms), void
elements, raw text and an end at the end of the file: an approximation of the
full parsing algorithm, which no library here has.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

PROSE = frozenset("a blockquote dd dt em figcaption h1 h2 h3 h4 h5 h6 li p span strong summary".split())
NOT_PROSE = frozenset("code kbd math noscript pre samp script style svg template tt var".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


@dataclass
class Node:
    tag: str
    line: int
    children: list = field(default_factory=list)  #: nodes and strings


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", 0)
        self.open = [self.root]

    def _close(self, k: int) -> None:
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end("p", stop=("button", "td", "th", "table", "caption", "object"))
        if tag in _SIBLINGS:
            same, within = _SIBLINGS[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in within:
                    break
                if self.open[k].tag in same.split():
                    self._close(k)
                    break
        if tag == "a":
            self._end("a")
        node = Node(tag, self.getpos()[0])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        foreign = any(n.tag in ("svg", "math") for n in self.open) or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)
        if foreign and tag not in _VOID:
            self.open.pop()

    def _end(self, tag: str, stop: tuple = ()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in stop:
                return

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def text_of(node: Node) -> str:
    """The text within, without that of elements that aren't prose."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.tag not in NOT_PROSE:
            todo += reversed(x.children)
    return "".join(out)


@lru_cache(maxsize=2)  # the rules of one page ask for the same text one after the other
def prose(html: str) -> list[tuple[str, int, str]]:
    """(tag, line, text) of each prose element with text, in document order; elements within others come too."""
    out, todo = [], [parse(html)]
    while todo:
        node = todo.pop()
        if node.tag in PROSE and (text := text_of(node)).strip():
            out.append((node.tag, node.line, text))
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out
