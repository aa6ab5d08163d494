"""Reader-visible text of an HTML page.

Tag handling needs a real tokenizer, so it runs as an Arrow-batched Python function that emits
raw text. Everything after it (white space, blank lines, table rows) is a JVM expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import scope
from factloom.functions.text import normalise

PAGES_AT_ONCE = 128
_EFFECT = {tag: "break" for tag in scope.BLOCK_TAGS} | {"tr": "row", "td": "cell", "th": "cell"}


class _VisibleText(HTMLParser):
    """Collects visible pieces; `hidden` names the subtree being skipped, `depth` its nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden, self.depth, self.row_has_cell = "", 0, False

    def _visible(self, tag: str, step: int) -> bool:
        if not self.hidden and step > 0 and tag in scope.HIDDEN_TAGS:
            self.hidden = tag
        if not self.hidden:
            return True
        self.depth += step if tag == self.hidden else 0
        if not self.depth:
            self.hidden = ""
        return False

    def _mark(self, tag: str, opening: bool) -> None:
        effect = _EFFECT.get(tag)
        if effect == "cell":
            if opening and self.row_has_cell:
                self.pieces.append(scope.CELL_SEPARATOR)
            self.row_has_cell = True
        elif effect:
            self.pieces.append("\n")
            self.row_has_cell = self.row_has_cell and effect != "row"

    def handle_starttag(self, tag, attrs):
        if self._visible(tag, +1):
            self._mark(tag, True)

    def handle_endtag(self, tag):
        if self._visible(tag, -1):
            self._mark(tag, False)

    def handle_data(self, data):
        if not self.hidden and not data.isspace():
            self.pieces.append(data)


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    reader = _VisibleText()
    reader.feed(page)
    reader.close()
    return "".join(reader.pieces)


def read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts of all pages, a few at a time: a worker holds the batch it was given and no second one of texts."""
    for html in batches:
        for at in range(0, len(html), PAGES_AT_ONCE):
            yield pa.array([visible_text(page.as_py()) for page in html.slice(at, PAGES_AT_ONCE)], pa.string())
        del html
        pa.default_memory_pool().release_unused()


@F.arrow_udf(T.StringType())
def raw_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from read_pages(batches)


def html_to_text(html: Column) -> Column:
    return normalise(raw_text(html))
