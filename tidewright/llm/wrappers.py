"""Operator 2, HTML extraction by wrapper induction.

One page of a host, the distinct one of smallest hash, is its reference, and every page of the host is aligned with it by simple tree matching: two
nodes match if their labels (tag and classes) agree, their children by the best order-keeping alignment. Runs of like siblings count as one repeated
slot of many members, and so do all siblings of one label where a node has more than WIDE runs. A node of the reference that has the same text in every page, or a member
that every page has, is constant; for that each page gives one bit a node, and bits of any number of pages combine by "and", in any order:
within tasks first and then over the tasks, at most FAN at a time, so that a host of any size is never gathered and its template
does not depend on how pages are dealt. Constant nodes are the host's template; places whose text varies are slots, and slots hold content.

A page's text is taken from its article (article, main, role=main or articleBody elements), or, where it marks none, from
all of its slots in page order. Left out are template nodes, and roles that are never content: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments, by tag, role or class. A class or id counts as
a whole: has-sidebar is no sidebar. What holds the article or most of the page's varying text is kept whatever it is called. A marked article
without any varying text is kept whole, as the pages of a host may all repeat one article; a host's copies of one page aren't its template.

Elements nested deeper than dom.DEPTH are taken as neighbours, as browsers do beyond a depth of their own; their text stays in place.

Cases: a null or empty page has empty text; a null url is a host of its own; a host of fewer than MIN_PAGES pages, or whose pages
don't vary, has no template; repeated rows are rows like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, small_batches

from tidewright.llm.dom import BLOCKS, Node, parse

MIN_PAGES, FAN = 3, 64
#: Runs of children beyond which a node's children are aligned by their labels alone.
WIDE = 128
#: Bytes of reference pages up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
MASKS = "host string, mask binary"
#: Hosts whose chosen page is broadcast, at some 60 bytes each.
BROADCAST_HOSTS = 500_000
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Tags and the words of classes, ids and roles that by custom mark what is never content.
NEVER_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog head title menu search".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden login masthead menu menubar modal nav navbar "
    "navigation newsletter notice pager pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside those in a class: share-box is a box for sharing.
PLAIN_WORDS = frozenset("area articles bar block body bottom box button buttons container form icons inner item items left link links list main outer panel posts primary right row secondary section site slot stories top wrap wrapper".split())
#: Tags that hold no text of the page, whatever is in them.
UNSEEN_TAGS = frozenset("script style noscript template iframe object embed svg canvas button select textarea input head title".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WORDS = re.compile(r"[a-z]+")


def marks_of(found: dict[str, str]) -> set[str]:
    """The words of those classes and ids that say one thing only: sidebar and share-box, not has-sidebar or post-header."""
    out: set[str] = set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = set(WORDS.findall(token))
        if words <= NEVER_WORDS | ARTICLE_WORDS | PLAIN_WORDS:
            out |= words
    return out


def is_header(node: Node) -> bool:
    return node.tag == "header" or ("header" in node.attributes and "header" in marks_of(node.attribute("class", "id")))


def never(node: Node, in_article: bool, kept: set[int] = frozenset()) -> bool:
    """Is the node of a kind that holds no content, and not one of those kept?"""
    tag = node.tag
    if tag in UNSEEN_TAGS:
        return True
    if id(node) in kept:
        return False
    if tag in NEVER_TAGS or (tag == "header" and not in_article):
        return True
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    found = node.attribute("class", "id", "role", "hidden", "aria-hidden", "style")
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in NEVER_ROLES:
        return True
    words = marks_of(found) & (ARTICLE_WORDS if tag == "article" else NEVER_WORDS)
    return bool(words - {"header"} if in_article else words) and not (tag == "header" and in_article)


def holds(node: Node, tag: str) -> bool:
    return any(x.tag == tag or holds(x, tag) for x in node.children())


def is_comments(node: Node) -> bool:
    """Is the node made of readers' comments? What holds a page's first heading is more than those."""
    return bool(node.attributes) and node.tag not in ("html", "body", "main") and bool(marks_of(node.attribute("class", "id")) & COMMENT_WORDS) and not holds(node, "h1")


# -- templates ------------------------------------------------------------------------------------------------------------------------


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class Block:
    """A block of a page: its label, the hash of its own text, its children as runs, one hash of all of it, its nodes. A repeated slot has
    members: the hashes of its blocks, and the blocks. bits: its own, one for each member, and those of its children."""

    __slots__ = ("label", "text", "children", "members", "nodes", "whole", "size", "bits")

    def __init__(self, label: str, text: int, children: list, nodes: list[Node], members: list[int] | None = None) -> None:
        self.label, self.text, self.children, self.nodes, self.members = label, text, children, nodes, members or []
        self.whole = hash_of(f"{label} {text} {[c.whole for c in children]} {self.members}")
        self.size, self.bits = 1 + sum(c.size for c in children), 1 + len(self.members) + sum(c.bits for c in children)


def slot(runs: list[Block]) -> Block:
    """Blocks of one label as one repeated slot."""
    members = [m for r in runs for m in (r.members or [r.whole])]
    return Block(runs[0].label, 0, [], [n for r in runs for n in r.nodes], members)


def skeleton(node: Node) -> Block:
    """The page's block structure; the text of inline parts belongs to the block around them."""
    texts, children = [], []

    def walk(x: Node) -> None:
        for item in x.items:
            if isinstance(item, str):
                texts.append(item)
            elif item.tag in BLOCKS:
                children.append(skeleton(item))
            elif item.tag not in ("script", "style"):
                walk(item)

    walk(node)
    runs: list[list[Block]] = []
    for child in children:
        if runs and runs[-1][0].label == child.label:
            runs[-1].append(child)
        else:
            runs.append([child])
    classes = node.attribute("class").get("class", "")
    label = node.tag + "".join("." + c for c in sorted(set(classes.split())))
    return Block(label, hash_of(" ".join("".join(texts).split())), [r[0] if len(r) == 1 else slot(r) for r in runs], [node])


def by_label(children: list[Block]) -> dict[str, Block]:
    found: dict[str, list[Block]] = {}
    for child in children:
        found.setdefault(child.label, []).append(child)
    return {label: slot(blocks) if len(blocks) > 1 or blocks[0].members else blocks[0] for label, blocks in found.items()}


def match(a: Block, b: Block, known: dict) -> tuple[int, list[tuple[Block, Block]]]:
    """Simple tree matching of the children of two nodes of one label: matched nodes, and which children pair up."""
    x, y = a.children, b.children
    if not x or not y:
        return 1, []
    if (id(a), id(b)) in known:
        return known[id(a), id(b)]
    if a.whole == b.whole:
        found = a.size, list(zip(x, y, strict=True))
    elif max(len(x), len(y)) > WIDE:
        left, right = by_label(x), by_label(y)
        pairs = [(left[label], right[label]) for label in left if label in right]
        found = 1 + len(pairs), pairs
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        weight = [[match(p, q, known)[0] if p.label == q.label else 0 for q in y] for p in x]
        for i in range(1, len(x) + 1):
            row, above, w = best[i], best[i - 1], weight[i - 1]
            for j in range(1, len(y) + 1):
                row[j] = max(above[j], row[j - 1], above[j - 1] + w[j - 1])
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                pairs.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        found = 1 + best[len(x)][len(y)], pairs[::-1]
    known[id(a), id(b)] = found
    return found


class Reference:
    """A host's reference page, and where the bits of each of its blocks begin."""

    def __init__(self, page: str) -> None:
        self.tree, self.at, n = skeleton(parse(page)), {}, 0
        todo = [self.tree]
        while todo:
            block = todo.pop()
            self.at[id(block)] = n
            n += 1 + len(block.members)
            todo += block.children[::-1]
        self.n = n

    def agreed(self, page: str) -> np.ndarray:
        """A bit for each block and member of the reference: has the page the same text there?"""
        bits, known = np.zeros(self.n, bool), {}

        def align(mine: Block, ref: Block) -> None:
            at = self.at.get(id(ref))
            if at is None or mine.members or ref.members:
                self.members(mine, ref, bits)
                return
            bits[at] = mine.text == ref.text
            if mine.whole == ref.whole:
                bits[at : at + ref.bits] = True
                return
            for p, q in match(mine, ref, known)[1]:
                align(p, q)

        tree = skeleton(parse(page))
        if tree.label == self.tree.label:
            align(tree, self.tree)
        return bits

    def parts(self, ref: Block) -> list[tuple[int, int, int]]:
        """(hash, first bit, bits) of each member of a repeated slot, or of a block as the only one."""
        at = self.at.get(id(ref))
        if at is not None:
            return [(m, at + 1 + i, 1) for i, m in enumerate(ref.members)] or [(ref.whole, at, ref.bits)]
        out = []
        for node in ref.nodes:  # a slot made of all blocks of one label
            out += self.of_node[id(node)]
        return out

    @property
    def of_node(self) -> dict[int, list[tuple[int, int, int]]]:
        """The bits of each element of the reference page."""
        if not hasattr(self, "_of_node"):
            self._of_node, todo = {}, [self.tree]
            while todo:
                block = todo.pop()
                for node, part in zip(block.nodes, self.parts(block), strict=True):
                    self._of_node[id(node)] = [part]
                todo += block.children
        return self._of_node

    def members(self, mine: Block, ref: Block, bits: np.ndarray) -> None:
        have = set(mine.members or [mine.whole])
        if (at := self.at.get(id(ref))) is not None and ref.members:
            bits[at] = True
        for known, lo, n in self.parts(ref):
            if known in have:
                bits[lo : lo + n] = True

    def constant(self, tree: Block, mask: np.ndarray) -> set[int]:
        """ids of the page's elements that are template: aligned with what every page has with the same text, and all below it."""
        out: set[int] = set()
        known: dict = {}

        def visit(mine: Block, ref: Block) -> None:
            for p, q in match(mine, ref, known)[1]:
                at = self.at.get(id(q))
                if at is None or p.members or q.members:
                    always = {m for m, lo, n in self.parts(q) if mask[lo : lo + n].all()}
                    out.update(id(x) for x, m in zip(p.nodes, p.members or [p.whole], strict=True) if m in always)
                elif p.whole == q.whole and mask[at : at + q.bits].all():
                    out.update(map(id, p.nodes))
                else:
                    visit(p, q)

        if tree.label == self.tree.label:
            visit(tree, self.tree)
        return out


def _masks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for host, rows in frame.groupby("host", sort=False):
            reference = Reference(rows["reference"].iloc[0])
            mask = np.ones(reference.n, bool)
            for page in rows["html"]:
                mask &= reference.agreed(page)
            yield pd.DataFrame({"host": [host], "mask": [mask.tobytes()]})


def _all_of(rows: pd.DataFrame) -> pd.DataFrame:
    mask = np.frombuffer(rows["mask"].iloc[0], bool)
    for other in rows["mask"].iloc[1:]:
        mask = mask & np.frombuffer(other, bool)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "mask": [mask.tobytes()]})


def host_column(url: str) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), url, F.lit("")))


def references(pages: DataFrame) -> DataFrame:
    """(host, reference) of hosts of MIN_PAGES distinct pages or more. pages: host, html, none null or empty."""
    kinds = pages.groupBy("host", F.xxhash64("html").alias("kind")).agg(F.count("*").alias("pages"))
    chosen = kinds.groupBy("host").agg(F.min("kind").alias("kind"), F.count("*").alias("kinds")).where(F.col("kinds") >= MIN_PAGES).select("host", "kind")
    chosen = cut(chosen, "chosen")
    few = chosen.count() <= BROADCAST_HOSTS
    found = pages.withColumn("kind", F.xxhash64("html")).join(F.broadcast(chosen) if few else chosen, ["host", "kind"])
    return found.groupBy("host").agg(F.min("html").alias("reference"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, reference, mask) of the hosts that have a template. pages: host, html."""
    pages = pages.where("html != ''")
    known = cut(references(pages), "references")
    size = known.agg(F.sum(F.length("reference"))).first()[0] or 0
    partial = pages.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host").mapInPandas(_masks, MASKS)
    dealt = partial.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(FAN)))
    masks = dealt.groupBy("host", "salt").applyInPandas(_all_of, MASKS).groupBy("host").applyInPandas(_all_of, MASKS)
    return known.join(masks, "host")


# -- extraction -----------------------------------------------------------------------------------------------------------------------


def find_articles(node: Node, found: list[Node], kept: set[int]) -> list[Node]:
    """The outermost elements that mark the article."""
    for child in node.children():
        if never(child, False, kept):
            continue
        if child.tag == "article" or is_main(child):
            inner = find_articles(child, [], kept) if child.tag != "article" else []
            found += [x for x in inner if x.tag == "article"] or [child]
        else:
            find_articles(child, found, kept)
    return found


def is_main(node: Node) -> bool:
    marks = node.attribute("role", "itemprop") if node.attributes else {}
    return node.tag == "main" or marks.get("role", "").lower() in ("main", "article") or "articlebody" in marks.get("itemprop", "").lower()


def lengths(node: Node, constant: set[int], linked: bool, out: dict[int, int]) -> int:
    """Characters of varying text outside links and comments, of each node."""
    total = 0
    for item in node.items:
        if isinstance(item, str):
            total += 0 if linked else len(item.strip())
        elif id(item) not in constant and item.tag not in UNSEEN_TAGS and not is_comments(item):
            total += lengths(item, constant, linked or item.tag == "a", out)
    out[id(node)] = total
    return total


def content_of(root: Node, constant: set[int]) -> tuple[list[Node], set[int]]:
    """The elements that mark the article, none where the page marks none, and ids of what is never dropped: what holds them or most of the varying text."""
    sizes: dict[int, int] = {}
    total = lengths(root, constant, False, sizes)
    kept = {x for x, size in sizes.items() if 2 * size > total}
    articles = find_articles(root, [], kept)
    if not articles:
        # an article in what is called a sidebar or the like, unless it is a teaser beside the text
        inside = [x for x in find_articles(root, [], sizes.keys() - teasers(root, set())) if sizes.get(id(x), 0)]
        articles = [x for x in inside if is_main(x) or holds(x, "h1")]
        if not articles and len(inside) == 1 and sizes[id(inside[0])] > len(text_of(root, constant, False, kept)):
            articles = inside
    return articles, kept


def teasers(node: Node, out: set[int]) -> set[int]:
    """ids of article elements whose class says that they are adverts, comments or teasers."""
    for child in node.children():
        if child.tag == "article" and never(child, False):
            out.add(id(child))
        teasers(child, out)
    return out


def text_of(root: Node, constant: set[int], marked: bool, kept: set[int]) -> str:
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(inline).split()):
            blocks.append(text)
        inline.clear()

    def walk(node: Node, in_header: bool) -> None:
        for item in node.items:
            if isinstance(item, str):
                if not in_header:
                    inline.append(item)
                continue
            if id(item) in constant or never(item, marked, kept):
                if item.tag in BLOCKS:
                    flush()
                continue
            if item.tag == "br":
                inline.append(" ")
            elif item.tag in BLOCKS:
                flush()
                # of an article's own header, its headings
                walk(item, (in_header or (id(item) not in kept and is_header(item))) and item.tag not in HEADINGS)
                flush()
            else:
                walk(item, in_header)

    walk(root, False)
    flush()
    return "\n".join(blocks)


def main_text(page: str | None, reference: Reference | None = None, mask: np.ndarray | None = None) -> str:
    if not page:
        return ""
    tree = skeleton(parse(page)) if reference else None
    root = tree.nodes[0] if tree else parse(page)
    constant = reference.constant(tree, mask) if tree else set()
    articles, kept = content_of(root, constant)
    if not articles:
        return text_of(root, constant, False, kept)
    parts = [text_of(x, constant, True, kept) or text_of(x, set(), True, kept) for x in articles]
    return "\n".join(x for x in parts if x)


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, read = [], {}
        for host, page, reference, mask in zip(frame["host"], frame["html"], frame["reference"], frame["mask"], strict=True):
            if isinstance(reference, str) and host not in read:
                read[host] = Reference(reference), np.frombuffer(mask, bool)
            texts.append(main_text(page if isinstance(page, str) else None, *read.get(host, ())))
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(x) for x in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_column("url"))
    known = cut(templates(rows.select("host", "html")), "templates")
    size = known.agg(F.sum(F.length("reference") + F.length("mask"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    return joined.select("page_id", "url", "host", "html", "reference", "mask").mapInPandas(_extracted, SCHEMA)
