"""A small tolerant HTML tree: what block structure and text extraction need of a page."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these, as far as the scope reaches.
CLOSES = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["tbody", "thead", "tfoot"]), "tfoot": frozenset(["tbody", "thead"]),
}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
P_CLOSERS = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot option optgroup legend summary".split())
P_SCOPE = frozenset("article aside body dd div dt fieldset figure footer form header html li main nav section table td th".split())


#: Deepest nesting; an element beyond is an empty neighbour of what it holds.
DEPTH = 200


class Node:
    """An element; items are its children and texts in page order."""

    __slots__ = ("tag", "attributes", "items")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.items = tag, attributes, []

    def attribute(self, *names: str) -> dict[str, str]:
        if not self.attributes or self.attributes.isspace():
            return {}
        found = {}
        for hit in ATTRIBUTE.finditer(self.attributes):
            if (name := hit[1].lower()) in names and name not in found:
                found[name] = html.unescape(hit[2] or hit[3] or hit[4] or "")
        return found

    def children(self):
        return (x for x in self.items if isinstance(x, Node))


def parse(page: str) -> Node:
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    beyond: dict[str, int] = {}  # open elements deeper than DEPTH

    def close(tags: frozenset, scope: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < n:
        hit = TOKEN.search(page, at)
        end = hit.start() if hit else n
        if end > at:
            text = page[at:end]
            stack[-1].items.append(html.unescape(text) if "&" in text else text)
        if not hit:
            break
        at = hit.end()
        tag = (hit[2] or hit[5] or "").lower()
        if not tag:
            if hit[0].startswith("<![CDATA["):
                stack[-1].items.append(hit[0][9:].removesuffix("]]>"))
            continue
        if hit[1] or hit[4]:
            if beyond.get(tag):
                beyond[tag] -= 1
                stack[-1].items.append(Node(tag))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:  # an inline end tag doesn't close blocks
                    break
            continue
        attributes = hit[3] or hit[6] or ""
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            root.attributes += attributes if tag == "html" else ""
            continue
        if tag in P_CLOSERS:
            close(frozenset(["p"]), P_SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, frozenset(["table", "select"])))
        node = Node(tag, attributes)
        stack[-1].items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS and tag in ("path", "circle", "rect", "use")):
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                beyond[tag] = beyond.get(tag, 0) + 1
    return root
