"""Text expressions: whitespace, lines, tokens, table rows. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import scope

# Unicode white space as a regular-expression class (fixed values).
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A lone "$(" or "(", or a "$" and a "(" after it, at the begin of a cell; and the whole cell that follows.
_GLUED = r"(?<=^|\| )(?:(\$?\()|(\$)(?: \| (\()(?= \||\z))?)(?: \| ([^|]+))?"


def strip(text: Column) -> Column:
    """Looks at the ends only; a regular expression would be tried at every character."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Every white-space run becomes one blank; none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def split_items(text: Column) -> Column:
    """Comma list to array, trimmed, blanks dropped; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(parts, lambda part: part != "")


def tidy_row(line: Column) -> Column:
    """Drop spacer cells and attach a lone currency sign or bracket to the cell after it.

    Expressions for the whole line: a fold over its cells copies the row so far at every cell."""
    parted = F.regexp_replace(line, rf"{SPACE}*+\|[{SPACE[1:-1]}|]*+", scope.CELL_SEPARATOR)
    cells = F.regexp_replace(parted, rf"^[{SPACE[1:-1]}|]++|[{SPACE[1:-1]}|]++\z", "")
    return F.regexp_replace(cells, _GLUED, "$1$2$3$4")


def normalise(raw: Column) -> Column:
    """Collapse blanks inside lines, drop blank and pipe-only lines, tidy table rows."""
    cleaned = F.transform(lines(raw), collapse)
    kept = F.filter(cleaned, lambda line: F.btrim(line, F.lit(" |")) != "")
    tidied = F.transform(
        kept, lambda line: F.when(line.contains("|"), tidy_row(line)).otherwise(line)
    )
    return F.array_join(tidied, "\n")


def is_table_row(line: Column) -> Column:
    return line.contains(scope.CELL_SEPARATOR)


def words(text: Column) -> Column:
    """Lower-cased letter runs: the unstemmed analyser."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def or_query(terms: Column) -> Column:
    """Distinct terms as a disjunctive query string."""
    return F.array_join(F.array_sort(F.array_distinct(terms)), " | ")


def leaked_prefixes(text: Column, prefixes=scope.LEAK_PREFIXES) -> Column:
    known = F.array(*[F.lit(p) for p in sorted(prefixes)])
    return F.filter(known, lambda prefix: text.contains(prefix))
