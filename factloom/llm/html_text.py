"""Main text of web pages: flat text blocks, features of a block and its neighbours, a decision tree.

A page is cut into blocks at block-level tags; inside a block markup is dropped, character references are decoded and white space becomes one space. Per block: word count and link density, those of the
blocks before and after it, and two facts of its place: inside a container that holds page furniture (nav, header, footer, aside, form, or an element
whose class, id or role says menu, advert, comment, ...), and inside article or main. A CART decision tree, fitted to the small labelled table below, decides
which blocks are main text. Comments and invisible elements are no blocks: scripts, styles, titles and text areas are passed over to their own end tag, whatever stands in them;
buttons, selects, svg, noscript and the like are elements as others, not seen while open. Everything happens within a row.

Edge cases: null and empty pages have no text; unclosed and unknown tags, stray < and truncated pages are read as far as they go; a script or style without end takes the rest of the page, other
invisible elements without end take nothing but what stands before the next block, a button or select never more than that; text outside any tag is a block; other
columns pass through, one named like the result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: HTML ---------------------------------------------------------------------
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # their content is no markup
UNENDED = frozenset(("script", "style"))  # raw to the end of the page where the end tag is missing
INVISIBLE = frozenset("noscript template object svg math canvas audio video select button datalist".split())
INLINE_ONLY = frozenset(("select", "button", "datalist"))  # hold no blocks but OPTIONS
OPTIONS = ("option", "optgroup")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog head".split())
CONTENT = frozenset(("article", "main"))
SAYS_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|sidebar|widget\w*|comments?|replies|reply|respond|disqus|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe\w*|signup|login|search\w*|share|sharing|social\w*|related|recommended|pagination|pager|toolbar|"
    r"copyright|legal|disclaimer|form|tags?|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)

# --- labelled blocks: words, link density, words and density before, words and density after, in furniture, in content, is main text ----
LABELLED = (
    (6, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 6, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (12, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0), (45, 0.0, 20, 0.0, 60, 0.0, 1, 0, 0), (120, 0.0, 45, 0.0, 80, 0.0, 1, 0, 0),
    (9, 0.1, 90, 0.0, 0, 0.0, 1, 0, 0), (30, 0.1, 140, 0.0, 0, 0.0, 1, 0, 0), (4, 0.0, 10, 0.0, 150, 0.0, 1, 0, 0), (25, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0),
    (60, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0), (8, 0.0, 30, 0.0, 60, 0.0, 1, 1, 0), (2, 1.0, 80, 0.0, 3, 1.0, 1, 1, 0), (200, 0.02, 5, 0.0, 30, 0.0, 1, 1, 0),
    (10, 0.0, 12, 0.0, 150, 0.0, 0, 1, 1), (150, 0.0, 10, 0.0, 90, 0.0, 0, 1, 1), (3, 0.0, 80, 0.0, 12, 0.1, 0, 1, 1), (1, 0.0, 40, 0.0, 60, 0.0, 0, 1, 1),
    (70, 0.05, 2, 0.0, 3, 0.0, 0, 1, 1), (12, 1.0, 90, 0.0, 70, 0.0, 0, 1, 1), (5, 1.0, 8, 0.0, 30, 0.0, 0, 1, 1), (400, 0.1, 0, 0.0, 0, 0.0, 0, 1, 1),
    (30, 0.4, 50, 0.0, 0, 0.0, 0, 1, 1), (2, 0.5, 100, 0.0, 100, 0.0, 0, 1, 1), (6, 0.0, 1, 1.0, 45, 0.0, 0, 1, 1), (25, 0.0, 25, 0.0, 4, 1.0, 0, 1, 1),
    (90, 0.0, 10, 0.0, 70, 0.0, 0, 0, 1), (40, 0.05, 90, 0.0, 60, 0.0, 0, 0, 1), (25, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1), (8, 0.0, 4, 1.0, 80, 0.0, 0, 0, 1),
    (15, 0.1, 70, 0.0, 90, 0.0, 0, 0, 1), (200, 0.1, 2, 1.0, 3, 1.0, 0, 0, 1), (12, 0.0, 120, 0.0, 45, 0.1, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (6, 0.0, 3, 1.0, 1, 0.9, 0, 0, 0), (20, 0.8, 5, 0.9, 4, 1.0, 0, 0, 0), (50, 0.7, 8, 1.0, 6, 0.9, 0, 0, 0),
    (4, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0), (2, 1.0, 1, 1.0, 90, 0.0, 0, 0, 0), (6, 0.9, 4, 1.0, 0, 0.0, 0, 0, 0), (15, 0.8, 70, 0.0, 0, 0.0, 0, 0, 0),
    (3, 0.0, 2, 0.9, 4, 0.8, 0, 0, 0), (35, 0.6, 90, 0.0, 4, 1.0, 0, 0, 0), (5, 0.9, 80, 0.0, 6, 1.0, 0, 0, 0), (7, 0.5, 4, 1.0, 5, 1.0, 0, 0, 0),
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@lru_cache(maxsize=4)
def decision_tree(depth: int = 6) -> tuple:
    """CART on the labelled table: (feature, threshold, below, above) or a leaf's label."""

    def grow(rows: np.ndarray, left: int) -> tuple | bool:
        y = rows[:, -1]
        if not left or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] < t
                gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or gini < best[0] - 1e-12:
                    best = gini, f, float(t), low
        if best is None:
            return bool(y.mean() >= 0.5)
        _, f, t, low = best
        return f, t, grow(rows[low], left - 1), grow(rows[~low], left - 1)

    return grow(np.array(LABELLED, float), depth)


def decide(features: tuple, node) -> bool:
    while isinstance(node, tuple):
        f, t, below, above = node
        node = below if features[f] < t else above
    return node


@lru_cache(maxsize=4096)
def furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    return bool(attributes) and (bool(HIDDEN.search(attributes)) or any(SAYS_FURNITURE.search(v) for m in ATTRIBUTE.findall(attributes) for v in m if v))


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """Text, words, link density, in furniture, in content, of each block in page order."""
    out: list[tuple[str, int, float, bool, bool]] = []
    said: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, furniture, content
    anchors, bad, good, hidden = 0, 0, 0, 0
    last_end: dict[str, int] = {}

    def ends_after(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = lowered.rfind(f"</{tag}")
        return last_end[tag] >= at

    def leave(i: int) -> None:
        nonlocal bad, good, hidden
        for name, f, c in stack[i:]:
            bad, good, hidden = bad - f, good - c, hidden - (name in INVISIBLE)
        del stack[i:]

    def close() -> None:
        text = " ".join(html.unescape("".join(said)).split())
        if text:
            total = text.count(" ") + 1
            links = len(html.unescape(" ".join(linked)).split())
            out.append((text, total, min(1.0, links / total), bad > 0, good > 0))
        said.clear()
        linked.clear()

    lowered, at = page.encode(errors="replace").lower().decode(), 0  # ASCII only: offsets stay
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if hidden or piece[:2] in ("<!", "<?"):
                continue
            said.append(piece)
            if anchors:
                linked.append(piece)
            continue
        tag, ending = tag.lower(), bool(m[1])
        if tag in RAW:
            said.append(" ")
            if not ending:
                end = lowered.find(f"</{tag}", at)
                at = end if end >= 0 else len(page) if tag in UNENDED else at
            continue
        if not ending and tag not in OPTIONS and (tag in BLOCKS or tag in INLINE_ONLY):
            # A button or select that was not closed ends at the next block, button or select.
            i = len(stack) - 1
            while i >= 0 and stack[i][0] in OPTIONS:
                i -= 1
            if i >= 0 and stack[i][0] in INLINE_ONLY:
                leave(i)
        if tag in BLOCKS and not hidden:
            close()
        elif tag == "br" or tag in INVISIBLE:
            said.append(" ")
        if tag == "a":
            anchors = max(0, anchors - 1) if ending else 1
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
        elif tag in INVISIBLE:
            if not m[3].endswith("/") and (tag in INLINE_ONLY or ends_after(tag, at)):
                stack.append((tag, False, False))
                hidden += 1
        elif tag not in VOID and not m[3].endswith("/"):
            is_bad = tag not in ("html", "body") and furniture(tag, m[3])
            # A heading's header inside the article is part of it.
            if tag == "header" and good and not bad:
                is_bad = bool(m[3]) and furniture("div", m[3])
            is_good = tag in CONTENT
            if is_bad or is_good or tag in BLOCKS:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:  # closed by the next one
                    leave(len(stack) - 1)
                stack.append((tag, is_bad, is_good))
                bad, good = bad + is_bad, good + is_good
    close()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    tree, kept = decision_tree(), []
    if any(b[4] and not b[3] for b in found):  # where the page marks its content, text elsewhere is furniture
        found = [b if b[4] else (*b[:3], True, b[4]) for b in found]
    for i, (text, words, density, bad, good) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if decide((words, density, *before, *after, bad, good), tree):
            kept.append(text)
    return "\n".join(kept)


@F.arrow_udf(T.StringType())
def page_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in ``out``."""
    return pages.withColumn(out, page_texts(F.col(html_col).cast("string")))
