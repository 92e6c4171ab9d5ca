"""A small linear-time reader of HTML into a tree of elements with their texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

# An attribute's value is quoted only where a quote comes right after the equals
# sign; any other quote is a character like others, as the HTML standard has it.
_VALUE = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+"
_MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|" + _VALUE + r")*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'][^\s]*+)))?+")
_NAMING = ("class", "id", "role")


def _names(attributes: str) -> str:
    """Words of an element's class, id and role."""
    if "=" not in attributes:
        return ""
    return " ".join(a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in _NAMING).lower()


# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter "
    "output q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr".split()
)
_FOREIGN = ("svg", "math")
#: Elements that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag of the first kind ends an open element of the second within the scope.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
_P_SCOPE = frozenset("html body td th table button div section article main aside nav header footer form li blockquote figure".split())


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A)


@dataclass
class Tree:
    """Elements in page order; ``pieces`` are (element, text), and (element,
    None) where a block begins or ends."""

    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def parse(html: str) -> Tree:
    tree = Tree(["#root"], [""], [-1], [0])
    tags, names, parents, depths, pieces = tree.tags, tree.names, tree.parents, tree.depths, tree.pieces
    stack = [0]
    open_count: dict[str, int] = {}

    def pop() -> None:
        n = stack.pop()
        open_count[tags[n]] -= 1
        if tags[n] not in INLINE:
            pieces.append((n, None))

    def close(wanted: tuple[str, ...], scope: frozenset | tuple) -> None:
        if not any(open_count.get(w) for w in wanted):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = tags[stack[i]]
            if tag in wanted:
                while len(stack) > i:
                    pop()
                return
            if tag in scope:
                return

    at, n = 0, len(html)
    search = _MARK.search
    while at < n:
        found = search(html, at)
        if found is None:
            pieces.append((stack[-1], html[at:]))
            break
        if found.start() > at:
            pieces.append((stack[-1], html[at : found.start()]))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if open_count.get(tag):
                while tags[stack[-1]] != tag:
                    pop()
                pop()
            elif tag == "br":
                pieces.append((stack[-1], " "))
            continue
        if tag in _ENDS_P and open_count.get("p"):
            close(("p",), _P_SCOPE)
        rule = _ENDS.get(tag)
        if rule:
            close(*rule)
        if tag == "br":
            pieces.append((stack[-1], " "))
        attributes = found[3]
        node = len(tags)
        tags.append(tag)
        names.append(_names(attributes))
        parents.append(stack[-1])
        depths.append(depths[stack[-1]] + 1)
        if tag not in INLINE:
            pieces.append((node, None))
        # A slash at the end closes drawings and formulas alone.
        foreign = tag in _FOREIGN or any(open_count.get(f) for f in _FOREIGN)
        if tag in VOID or (foreign and attributes.endswith("/")):
            continue
        stack.append(node)
        open_count[tag] = open_count.get(tag, 0) + 1
        if tag in RAW:
            end = _raw_end(tag).search(html, at)
            until = end.start() if end else n
            pieces.append((node, html[at:until]))
            at = until
    return tree
