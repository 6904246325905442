"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path: tags with their classes and ids, so that
repeated elements share a path. For each path the text length outside links and the punctuation of its blocks
are summed; both ratios to the number of blocks are smoothed over the tree of paths and fused by their
product. A prior lowers the score of paths through elements whose tag, role, class or id speaks of menus,
headers, footers, sidebars, notices, adverts, forms or comments, unless the element holds nearly all text
of the page, and of paths outside the page's articles if it has any. The paths whose score reaches the
threshold select the regions: all articles (else main elements), or without these the deepest single element
that holds nearly all of the selected paths' score. Below a region a path is content, unless an element of
the kinds above is on it and its score stays under the threshold; without an article, parts that are nearly
all links are left out as well. Hidden elements, scripts, styles and the like are never text. Character
references are decoded, white space inside a block becomes one space, and blocks are joined by one space in
page order. The time is linear in the page, whatever its depth. Defined cases: null, empty and text-free
pages have an empty text; unclosed and mis-nested tags close at the next block of their kind or the end; text
without any element is content; repeated pages get a row each; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import text_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.DOTALL
)
#: A tag whose quotes do not match: it ends at the next mark.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_BEGINS_TAG = re.compile(r"</?[a-zA-Z]")
#: Name and value of one attribute; a quoted value whose quote does not close runs to the end of the tag.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")

#: Elements whose content is not text, up to their end tag.
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp"])
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block; all others begin and end blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are hardly ever main text.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select option menu dialog head fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of class and id that speak of the same, but not beside a word of WRAPPER_WORDS (as in has-sidebar).
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header masthead menu nav navbar navigation newsletter notice notices notification popup promo promoted recommended related replies reply "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
WRAPPER_WORDS = frozenset("has have no not with without".split())
#: Elements whose class and id say nothing about their text.
PLAIN_TAGS = frozenset(["html", "body", "article", "main"])
#: Paths are smoothed by weight exp(-(steps between them)**2 / 2), up to 4 steps; steps are tags to leave and enter.
_WEIGHTS = [math.exp(-steps * steps / 2) for steps in range(5)]
#: Ratios are summed as whole multiples of 1 / _FINE, so that differences of sums are exact.
_FINE = 1 << 40
#: What each element of a boilerplate kind, and a place outside all articles, makes of a path's score.
PRIOR = math.exp(-6)
#: The threshold, in standard deviations of the scores.
THRESHOLD = 0.8
#: The share of a page's text that makes an element a wrapper, and of the selected score that leads to a region.
NEARLY_ALL = 0.9
#: The share of links from which a part of a page without articles is a menu.
MOSTLY_LINKS = 0.8
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that end an open p, td, li and so on only inside themselves.
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_WITHIN = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
_AROUND_P = ("article", "main", "section", "div", "body", "td", "li", "blockquote")


def _speaks_of_boilerplate(value: str) -> bool:
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))}
        if words & BOILERPLATE_WORDS and not words & WRAPPER_WORDS:
            return True
    return False


def judged_tag(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, boilerplate, hidden) of an element; the label is its tag with its classes and id."""
    label, boilerplate, hidden = tag, tag in BOILERPLATE_TAGS, False
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "role":
            boilerplate |= value.lower() in BOILERPLATE_ROLES
        elif name in ("class", "id"):
            label += ("." if name == "class" else "#") + ".".join(sorted(value.split()))
            boilerplate |= tag not in PLAIN_TAGS and _speaks_of_boilerplate(value)
    return label, boilerplate, hidden


class Paths:
    """The tree of a page's paths; node 0 is the root, children have larger numbers than their parents."""

    def __init__(self) -> None:
        self.parent, self.tag, self.marked, self.elements = [0], [""], [False], [1]
        self.chars, self.linked, self.marks, self.blocks = [0], [0], [0], [0]
        self.known: dict[tuple[int, str, bool], int] = {}

    def enter(self, parent: int, tag: str, label: str, marked: bool) -> int:
        node = self.known.setdefault((parent, label, marked), len(self.parent))
        if node == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.marked.append(marked)
            for column in (self.elements, self.chars, self.linked, self.marks, self.blocks):
                column.append(0)
        self.elements[node] += 1
        return node

    def add(self, node: int, text: str, linked: int) -> None:
        self.chars[node] += max(0, len(text) - linked)
        self.linked[node] += min(len(text), linked)
        self.marks[node] += len(_PUNCTUATION.findall(text)) * (len(text) > linked)
        self.blocks[node] += 1

    def below(self, values: list) -> list:
        """The sums of values over each node and all below it."""
        out = list(values)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out


def parse(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The page's paths, and (path, text) of each block in page order; hidden elements are left out."""
    paths, out = Paths(), []
    stack: list[tuple[str, int, bool]] = []  # open block elements: tag, path, hidden
    open_tags: dict[str, int] = {}
    links, pieces, linked = 0, [], 0
    muted: list = []  # an inline element that is left out: its tag, how many of these are open, blocks around it

    def end_block() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            node = stack[-1][1] if stack else 0
            paths.add(node, text, linked)
            out.append((node, text))
        pieces, linked = [], 0

    def close(upto: int) -> None:
        for tag, _, _ in stack[upto:]:
            open_tags[tag] -= 1
        del stack[upto:]
        if muted and len(stack) < muted[2]:
            muted.clear()

    def nearest(kinds: tuple[str, ...], barriers: tuple[str, ...] = ()) -> int | None:
        if any(open_tags.get(k) for k in kinds):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in kinds:
                    return i
                if stack[i][0] in barriers:
                    return None
        return None

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        if token[4] == "<" and _BEGINS_TAG.match(page, at):
            token = _LOOSE_TAG.match(page, at)
            if token is None:  # a tag that never ends
                break
        at = token.end()
        closing, tag, attributes, text = (*token.groups(), None)[:4]
        if text is not None:
            if not muted and not (stack and stack[-1][2]):
                text = references.unescape(text)
                pieces.append(text)
                linked += len(text) if links else 0
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = _raw_end(tag).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag in ("br", "hr"):
            pieces.append(" ")
        if tag in VOID:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if muted:
                if tag == muted[0]:
                    muted[1] += -1 if closing else 1
                    if not muted[1]:
                        muted.clear()
            elif not closing and any(judged_tag(tag, attributes)[1:]):
                muted += [tag, 1, len(stack)]
            continue
        end_block()
        links = 0
        if closing:
            if (opened := nearest((tag,))) is not None:
                close(opened)
            continue
        for kinds, barriers in ((("p",), _AROUND_P), (_CLOSES.get(tag, ()), _WITHIN.get(tag, ()))):
            while (opened := nearest(kinds, barriers)) is not None:
                close(opened)
                if kinds == ("p",):
                    break
        label, boilerplate, hidden = judged_tag(tag, attributes)
        node = paths.enter(stack[-1][1] if stack else 0, tag, label, boilerplate)
        stack.append((tag, node, hidden or bool(stack and stack[-1][2])))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    end_block()
    return paths, out


_raw_ends: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _raw_ends:
        _raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE)
    return _raw_ends[tag]


def path_scores(paths: Paths) -> dict[int, float]:
    """The fused ratio of each path with text: smoothed text per block times smoothed punctuation per block,
    one added to each, times the number of its blocks."""
    steps = len(_WEIGHTS) - 1
    below: dict[int, list[list[int]]] = {}  # of each node, the number, text and punctuation of the paths at each depth below it
    with_text = [n for n, blocks in enumerate(paths.blocks) if blocks]
    ratios = {n: (round(paths.chars[n] / paths.blocks[n] * _FINE), round(paths.marks[n] / paths.blocks[n] * _FINE)) for n in with_text}
    for path, (length, marks) in ratios.items():
        node = path
        for down in range(steps + 1):
            row = below.setdefault(node, [[0, 0, 0] for _ in _WEIGHTS])[down]
            row[0] += 1
            row[1] += length
            row[2] += marks
            if not node:
                break
            node = paths.parent[node]
    out = {}
    for path in with_text:
        total = length = marks = 0.0
        node, inside = path, None  # inside: what is counted at a smaller distance
        for up in range(steps + 1):
            for down in range(steps - up + 1):
                n, chars, points = below[node][down]
                if inside and down:
                    n, chars, points = n - inside[down - 1][0], chars - inside[down - 1][1], points - inside[down - 1][2]
                if n:
                    weight = _WEIGHTS[up + down]
                    total += weight * n
                    length += weight * (chars / _FINE)
                    marks += weight * (points / _FINE)
            if not node:
                break
            inside, node = below[node], paths.parent[node]
        out[path] = (1 + length / total) * (1 + marks / total) * paths.blocks[path]
    return out


def marked_above(paths: Paths) -> list[int]:
    """For each path, how many of its elements are of a boilerplate kind; elements that hold nearly all text do
    not count if all articles, main elements and h1 with text and without such elements are inside."""
    text = paths.below(paths.chars)
    out = [0] * len(text)
    for node in range(1, len(out)):
        out[node] = out[paths.parent[node]] + paths.marked[node]
    kept = paths.below([b if t in ("article", "main", "h1") and not m else 0 for t, b, m in zip(paths.tag, text, out, strict=True)])
    for node in range(1, len(out)):
        wrapper = text[node] >= NEARLY_ALL * text[0] and kept[node] == kept[0]
        out[node] = out[paths.parent[node]] + (paths.marked[node] and not wrapper)
    return out


def articles(paths: Paths, marked: list[int]) -> list[int]:
    """For each path, the article on it that is nearest to the root and not of a boilerplate kind, else 0; if the
    page has no such article with text, the main element."""
    text = paths.below(paths.chars)
    for kind in ("article", "main"):
        out, any_text = [0] * len(text), False
        for node in range(1, len(out)):
            out[node] = out[paths.parent[node]] or (node if paths.tag[node] == kind and not marked[node] else 0)
            any_text |= bool(out[node] == node and text[node])
        if any_text:
            return out
    return [0] * len(text)


def content_paths(paths: Paths) -> set[int]:
    """The paths whose text is main text."""
    plain = path_scores(paths)
    if not plain:
        return set()
    marked = marked_above(paths)
    region = articles(paths, marked)
    outside = any(region)
    scores = {n: s * PRIOR ** (marked[n] + (outside and not region[n])) for n, s in plain.items()}
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    threshold = min(max(scores.values()), THRESHOLD * spread)
    selected = {n for n, s in scores.items() if s >= threshold}
    if outside:
        return {n for n in plain if region[n] and (not marked[n] or n in selected)}

    mass = paths.below([scores[n] if n in selected else 0.0 for n in range(len(paths.parent))])
    titles = paths.below([c if t == "h1" and not m else 0 for c, t, m in zip(paths.chars, paths.tag, marked, strict=True)])
    children: dict[int, list[int]] = {}
    for node in range(1, len(paths.parent)):
        children.setdefault(paths.parent[node], []).append(node)
    root = 0
    while below := [n for n in children.get(root, ()) if mass[n] >= NEARLY_ALL * mass[0] and paths.elements[n] == 1 and titles[n] == titles[root]]:
        if paths.blocks[below[0]] and paths.tag[below[0]] not in _AROUND_P:
            break  # a paragraph is no region
        root = below[0]
    text, linked = paths.below(paths.chars), paths.below(paths.linked)
    part = [0] * len(text)  # the child of the root that a path goes through
    out = set()
    for node in range(len(text)):
        up = paths.parent[node]
        part[node] = node if node and up == root else part[up]
        within = node == root or (node and part[node])
        if within and node in plain and (node in selected or (marked[node] <= marked[root] and not (part[node] and _menu(text, linked, part[node])))):
            out.add(node)
    return out


def _menu(text: list[int], linked: list[int], node: int) -> bool:
    return linked[node] >= MOSTLY_LINKS * (text[node] + linked[node])


def main_text(page: str | None) -> str:
    paths, found = parse(page) if page else (Paths(), [])
    content = content_paths(paths)
    return " ".join(text for path, text in found if path in content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            out = [main_text(page) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
