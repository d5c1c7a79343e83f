"""Operator 10, HTML extraction by tag-path ratios.

Every block of text has a root-to-leaf path of block-level tags. For each path the text length, punctuation and link text are summed;
their ratios to its number of blocks are smoothed along the tree of paths, fused, and thresholded: paths above the threshold are content,
and so is all that stands in the container that holds them, but for lists of links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from taktwerk.llm.common import read_table, ship

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|</?([a-zA-Z][^\s/>]*)[^>]*>|([^<]+)|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
LIST_OF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",), "option": ("select",)}
#: Elements whose text is never the article's.
APART = frozenset("head nav footer aside form script style noscript template button select option datalist textarea input svg canvas object audio video iframe menu dialog title noembed noframes search fieldset label".split())
#: Words of class, id or role attributes that mark text beside the article.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside complementary footer header masthead cookie cookies consent gdpr notice alert popup modal dialog overlay subscribe subscription newsletter signup login "
    "comment comments commentlist disqus respond replies reply discussion reader related recommended recommendations share sharing social widget toolbar pager pagination copyright legal search form skip hidden".split()
)
CONTENT_NAMES = frozenset("article content main story post entry".split())

#: A path is content if its fused score is at least this share of the highest.
THRESHOLD = 0.12
#: The container is the deepest element that holds at least this share of the text above the threshold.
HELD = 0.9
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


class _Open:
    __slots__ = ("tag", "apart", "node")

    def __init__(self, tag: str, apart: bool, node: int):
        """``apart``: it or an element around it stands apart; ``node``: its number in the tree of paths."""
        self.tag, self.apart, self.node = tag, apart, node


class Paths:
    """The tree of root-to-leaf tag paths; equal paths are one node, parents have smaller numbers than their children, 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.tag, self.depth, self.known = [0], [""], [0], {}

    def child(self, node: int, label: str, tag: str) -> int:
        if (k := self.known.get((node, label))) is None:
            k = self.known[node, label] = len(self.parent)
            self.parent.append(node)
            self.tag.append(tag)
            self.depth.append(self.depth[node] + 1)
        return k

    def upward(self, sums: list[list[float]]) -> list[list[float]]:
        """What subtrees hold, of what nodes hold: each node is added to its parent after all its children were added to it."""
        out = [list(x) for x in sums]
        for k in range(len(out) - 1, 0, -1):
            above = out[self.parent[k]]
            for i, x in enumerate(out[k]):
                above[i] += x
        return out

    def downward(self, first: Callable[[int], bool]) -> list[bool]:
        """Whether a node or one above it is a ``first``."""
        out = [first(0)]
        for k in range(1, len(self.parent)):
            out.append(out[self.parent[k]] or first(k))
        return out


def _is_apart(tag: str, names: list[str], inside: list[_Open]) -> bool:
    if tag in APART:
        return True
    if tag == "header":  # an article's own header holds its title
        return not any(o.tag in ("article", "main") for o in inside)
    if tag in ("html", "body", "main", "article"):
        return False
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n.lower()) if w}
    if words & CONTENT_NAMES and not words & {"comments", "comment", "sidebar", "related", "ad", "ads", "advert"}:
        return False
    return bool(words & APART_NAMES)


def blocks_of(source: str) -> tuple[list[tuple[int, str, int, bool]], Paths]:
    """The blocks of a page in order: (path, text, characters of link text, apart), and the tree of the paths."""
    stack: list[_Open] = []
    paths, opened = Paths(), Counter()  # opened: open elements by tag, so that the stack is not searched for what is not there
    out, pieces, links = [], [], 0
    in_link = 0
    at, size = 0, len(source)

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((stack[-1].node, text, links, stack[-1].apart) if stack else (0, text, links, False))
        pieces, links = [], 0

    def close(upto: int) -> None:
        flush()
        opened.subtract(o.tag for o in stack[upto:])
        del stack[upto:]

    while at < size:
        m = _TOKEN.match(source, at)
        at = m.end()
        if (text := m[5]) is not None:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                links += len(text)
            continue
        tag = m[2] or m[4]
        if tag is None:
            if m[0] == "<":
                pieces.append("<")
            continue
        tag = tag.lower()
        if m[1] or m[4] and m[0][1] == "/":
            if tag in INLINE:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if tag == "br":
                    pieces.append(" ")
                continue
            for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    in_link = 0
                    break
            continue
        attributes = m[3] or ""
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a" and not attributes.endswith("/"):
                in_link = 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            flush()
            at = end.end() if end else size
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1 if opened["p"] else -1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    in_link = 0
                    break
                if stack[i].tag in ("table", "td", "th", "button"):
                    break
        elif tag in ENDED_BY:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in LIST_OF.get(tag, ()):
                    break
                if stack[i].tag in ENDED_BY[tag]:
                    close(i)
                    in_link = 0
                    break
        flush()
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        names = [a or b or c for _, a, b, c in _NAMES.findall(attributes)] if attributes else []
        if tag == "body" and any(o.tag == "head" for o in stack):
            close(next(i for i, o in enumerate(stack) if o.tag == "head"))
        apart = bool(stack) and stack[-1].apart
        node = paths.child(stack[-1].node if stack else 0, ".".join([tag, *names]), tag)
        opened[tag] += 1
        stack.append(_Open(tag, apart or _is_apart(tag, names, stack), node))
    flush()
    return out, paths


def content_paths(blocks: list[tuple[int, str, int, bool]], tree: Paths) -> set[int]:
    """The paths that hold the article, by their ratios. Blocks that stand apart take no part."""
    size = len(tree.parent)
    sums = [[0.0, 0.0, 0.0, 0.0] for _ in range(size)]  # characters, punctuation, characters of links, blocks
    for path, text, links, apart in blocks:
        if not apart:
            p = sums[path]
            p[0] += len(text)
            p[1] += len(_PUNCTUATION.findall(text))
            p[2] += min(links, len(text))
            p[3] += 1
    paths = [k for k in range(size) if sums[k][3]]
    if not paths:
        return set()
    # Ratios of a subtree, so that a heading shares in what stands under the same parent.
    trees = tree.upward(sums)

    def score(s: list[float]) -> float:
        free = 1 - s[2] / s[0]
        return (s[0] / s[3]) * free * free * (1 + s[1] / s[3])

    # A subtree's share of all text makes the main container outweigh small ones of equal ratio.
    total = trees[0][0]
    around = {p: trees[tree.parent[p]] for p in paths}
    fused = {p: (0.5 * score(sums[p]) + 0.5 * score(around[p])) * (around[p][0] / total) for p in paths}
    best = max(fused.values())
    good = {p for p, f in fused.items() if f >= THRESHOLD * best}
    # Lists, quotations, tables and code have small parents of their own: the article's are told by the container, not by their own ratios.
    held = tree.upward([[sums[k][0] if k in good else 0.0] for k in range(size)])
    above = held[0][0]
    inner = [held[k][0] - (sums[k][0] if k in good else 0.0) for k in range(size)]  # a path is not its own container
    container = max((k for k in range(size) if inner[k] >= HELD * above), key=lambda k: tree.depth[k], default=0)
    inside = tree.downward(lambda k: k == container)
    good |= {p for p in paths if inside[p] and sums[p][2] <= 0.5 * sums[p][0]}
    named = tree.downward(lambda k: tree.tag[k] in ("article", "main"))
    main = [p for p in paths if named[p]]
    if main and 2 * sum(sums[p][0] for p in main) >= total:
        # A page that names its article: what stands in it and is not mostly links is content.
        good = {p for p in main if sums[p][2] <= 0.5 * sums[p][0]}
    return good


def extract_text(source: str | None) -> str:
    """The main text of a page: its content blocks, white space made single, joined by an empty line.

    Null and empty pages give an empty text; broken markup is read as browsers do: unclosed paragraphs and list items end at the next,
    stray end tags are passed over, an unclosed comment or script runs to the end.
    """
    if not source:
        return ""
    blocks, tree = blocks_of(source)
    good = content_paths(blocks, tree)
    return "\n\n".join(text for path, text, _, apart in blocks if not apart and path in good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html); repeated rows give repeated results."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
