"""Main text of web pages by tag-path ratios.

A page is read once, leniently, into text nodes with their root-to-leaf tag
paths.  Per path the lengths and punctuation marks of its nodes are summed;
both ratios (per node) are smoothed over the page's order of nodes, fused with
the path's own ratio into one weight, and paths above a share of the page's mean
weight are content.  What is returned follows from these paths alone:

* every block on a content path;
* what stands in an element most of whose text is on content paths: an article
  or main element, an element that holds content blocks directly, or the smallest
  one that holds all content.  Of the last, blocks of nothing but links go;
* headings, with the paragraphs after them, that lead into such a block.

Elements that by tag name or by class, id or role are menus, headers, footers,
sidebars, notices, adverts, forms, comments or not text at all never count.  A
class names boilerplate if all its words do, or layout words beside them; in the
latter case, comments apart, not if the element holds most of the page's text.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one newline; empty blocks vanish.

Defined results: null, empty and text-free pages give the empty string; a tag
cut off at the page's end is dropped; unclosed elements end with their parent;
repeated pages are extracted as often as they occur; extra columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courtline.llm.common import ship

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset(
    "head nav footer aside form menu dialog button select svg math canvas audio video object label fieldset "
    "script style textarea title noscript iframe template xmp noembed noframes".split())
CONTENT = frozenset("article main".split())
# fixed values: words of a class, id or role that name boilerplate
NAMED = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|nav\w*|menu\w*|"
    r"breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|form|search|login|signup|subscribe|newsletter|pagination|"
    r"pager|toolbar|contentinfo|complementary|navigation|skip", re.I)
# fixed values: layout words that may stand beside them
LAYOUT = frozenset(
    "site page main global top bottom left right primary secondary box container wrapper wrap list section area "
    "block bar slot unit item items inner outer links link buttons button holder panel text posts".split())
TALK = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|respond", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|$)"
    # a quote that never ends: the tag ends at the next bracket
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?P<close2>>|$)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡\"“”()]")
THRESHOLD = 0.25     # share of the mean fused weight that makes a path content
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    """A run of text: its block, its tag path, its open elements and whether it is boilerplate.

    ``doubted`` has the elements whose class mixes layout words with boilerplate.
    """

    __slots__ = ("block", "path", "elements", "text", "out", "doubted")

    def __init__(self, block: int, path: str, elements: tuple, text: str, out: bool, doubted: tuple):
        self.block, self.path, self.elements, self.text = block, path, elements, text
        self.out, self.doubted = out, doubted


def boilerplate(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether its class gives reason to doubt it is not."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True, False
    if not attrs or name in ("html", "body"):
        return False, False
    values = {k.lower(): a or b or c for k, a, b, c in reversed(ATTR.findall(attrs))}
    tokens = [t for k in ("class", "id", "role") for t in values.get(k, "").split()]
    named = [words for t in tokens if (words := [w for w in re.split("[-_]+", t) if w])
             and any(map(NAMED.fullmatch, words))
             and all(NAMED.fullmatch(w) or w.lower() in LAYOUT for w in words)]
    if any(any(map(TALK.fullmatch, words)) for words in named):
        return True, False
    if name in CONTENT:
        return False, False
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or UNSEEN.search(values.get("style", "")):
        return True, False
    sure = any(all(map(NAMED.fullmatch, words)) for words in named)
    return sure, bool(named) and not sure


def text_nodes(page: str) -> list[Node]:
    """The text nodes of a page in order."""
    nodes: list[Node] = []
    stack: list[tuple[str, int, bool, tuple]] = []   # name, element number, boilerplate and doubts from here on
    path, elements, out, doubted = "", (), False, ()
    block = count = at = 0

    def moved() -> None:
        nonlocal path, elements, out, doubted
        path = "/".join(s[0] for s in stack)
        elements = tuple(s[1] for s in stack)
        out = bool(stack) and stack[-1][2]
        doubted = stack[-1][3] if stack else ()

    def close(k: int) -> None:
        del stack[k:]
        moved()

    def text(a: int, z: int) -> None:
        if a < z:
            nodes.append(Node(block, path, elements, page[a:z], out, doubted))

    lower = None
    while True:
        m = TAG.search(page, at)
        if not m:
            # a lone "<" that opens no tag is text
            text(at, len(page))
            break
        text(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name or ">" not in (m["close"], m["close2"]):   # comment, declaration, or a tag cut off at the end
            continue
        if m["end"] or m["end2"]:                # end tag
            if name in BLOCK:
                block += 1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in CONTENT and name not in CONTENT and name not in ("body", "html"):
                    break                        # a stray end tag does not close the article
            continue
        if name in BLOCK:
            block += 1
            # an open paragraph, with the inline elements in it, ends where a block begins
            if name not in VOID:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or (name == stack[k][0] and name in ("li", "dt", "dd", "tr", "td", "th",
                                                                               "option")):
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
        if name in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        count += 1
        sure, doubt = boilerplate(name, attrs, any(s[0] in CONTENT for s in stack))
        stack.append((name, count, out or sure, (*doubted, count) if doubt else doubted))
        moved()
        if name in RAW:                          # its content is no markup
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
            if end < 0:
                found = re.compile(f"</{name}", re.I).search(page, at)
                end = found.start() if found else len(page)
            text(at, end)
            at = end
    return nodes


def content_paths(nodes: list[Node]) -> set[str]:
    """Paths whose fused, smoothed text and punctuation ratios pass the threshold."""
    length, marks, times = {}, {}, {}
    for n in nodes:
        length[n.path] = length.get(n.path, 0) + len(n.text.strip())
        marks[n.path] = marks.get(n.path, 0) + len(PUNCTUATION.findall(n.text))
        times[n.path] = times.get(n.path, 0) + 1
    ratio = np.array([length[n.path] / times[n.path] for n in nodes], float)
    points = np.array([marks[n.path] / times[n.path] for n in nodes], float)
    kernel = np.array([1, 2, 4, 2, 1], float) / 10

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 2, mode="edge"), kernel, mode="valid")

    # fusion: a short path beside long text stays light, and a path of long text without punctuation keeps a part
    fused = np.sqrt(ratio * smooth(ratio)) * (0.25 + smooth(points) / (1 + smooth(points)))
    sums: dict[str, float] = {}
    for n, w in zip(nodes, fused):
        sums[n.path] = sums.get(n.path, 0.0) + float(w)
    limit = THRESHOLD * float(fused.mean())
    return {p for p, s in sums.items() if s / times[p] >= limit}


def main_text(page: str | None) -> str:
    """The article's text, one line per block."""
    nodes = [n for n in text_nodes((page or "").replace("\x00", "")) if not n.out]
    nodes = _without_doubted(nodes)
    shown = [n for n in nodes if n.text.strip()]
    if not shown:
        return ""
    held = content_blocks(shown, content_paths(shown))
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.block in held:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _without_doubted(nodes: list[Node]) -> list[Node]:
    """Without the elements of doubtful class that do not hold most of the page's text."""
    size: dict[int, int] = {}
    for n in nodes:
        for e in n.doubted:
            size[e] = size.get(e, 0) + len(n.text.strip())
    if not size:
        return nodes
    total = sum(len(n.text.strip()) for n in nodes)
    return [n for n in nodes if all(2 * size[e] > total for e in n.doubted)]


def content_blocks(shown: list[Node], content: set[str]) -> set[int]:
    """The blocks that the content paths select."""
    full: dict[int, int] = {}        # characters in an element, and those of them on content paths
    good: dict[int, int] = {}
    depth: dict[int, int] = {}
    names: dict[int, str] = {}
    total = 0
    direct: set[int] = set()         # elements that hold content blocks directly
    for n in shown:
        size, on = len(n.text.strip()), n.path in content
        total += size * on
        holder = 0
        for d, (name, e) in enumerate(zip(n.path.split("/"), n.elements)):
            full[e] = full.get(e, 0) + size
            good[e] = good.get(e, 0) + size * on
            depth[e], names[e] = d, name
            if name in HOLDERS:
                holder = e
        if on:
            direct.add(holder)
    common = [e for e, c in good.items() if c == total]
    smallest = max(common, key=depth.__getitem__) if common and total else 0
    whole = {e for e, name in names.items() if (name in CONTENT or e in direct) and name not in ROOTS
             and 0 < full[e] <= 2 * good[e]}
    if names.get(smallest, "body") in ROOTS or full[smallest] > 2 * good[smallest]:
        smallest = 0
    kept: set[int] = set()
    leading: list[int] = []
    for n in shown:
        parts = n.path.split("/")
        linked = "a" in parts
        if (n.path in content or not whole.isdisjoint(n.elements)
                or (smallest in n.elements and not linked)):
            kept.update([n.block], leading)
            leading = []
        elif not linked and (not HEADINGS.isdisjoint(parts) or (leading and "p" in parts)):
            leading.append(n.block)
        elif n.block not in leading:
            leading = []
    return kept


ROOTS = frozenset(("html", "body"))
HOLDERS = frozenset(("div", "section", "td", "blockquote", *ROOTS, *CONTENT))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
