"""Packing lines by pointers against the fold over a document's lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import scope
from factloom.operators import chunk_pointers as cp
from factloom.operators.chunks import packed_ranges


def made(seed, n, long=0.02):
    r = random.Random(seed)
    lines = []
    for _ in range(n):
        size = 3000 if r.random() < long else r.choice([0, 0, 1, 30, 80, 200, 700])
        lines.append((" | ".join(["x" * (size // 3)] * 3) if r.random() < 0.4 else "y" * size))
    return lines


def test_pointers_lead_along_the_fold():
    for seed in range(30):
        lines = made(seed, random.Random(seed).choice([1, 2, 50, 400]))
        length, tabular = np.array([len(x) for x in lines]), np.array([" | " in x for x in lines])
        r = random.Random(seed)
        cuts = sorted({0, *(r.randrange(len(lines)) for _ in range(3))})
        section = np.searchsorted(cuts, np.arange(len(lines)), side="right")
        pointers = cp.next_starts(length, tabular, section, len(lines))
        got, at = [], 0
        while at < len(lines):
            got.append((at, int(pointers[at])))
            at = int(pointers[at])
        want = [c for a, b in zip(cuts, [*cuts[1:], len(lines)]) for c in packed_ranges(length, tabular, a, b)]
        assert got == want
        assert (cp.left_at(pointers) == len(lines)).all()


@pytest.mark.parametrize("sectioned", [False, True])
def test_one_document_with_a_third_of_all_lines(spark, sectioned):
    block = scope.MAX_CHARS + 2  # many blocks in the long document
    docs = {"long": made(1, 30_000), None: made(2, 5000, 0.3), **{f"d{i}": made(10 + i, 50 * i) for i in range(1, 45)}, "blank": ["", "  ", ""]}
    section_of = lambda i: f"s{i // 777 % 3}" if sectioned else "all"
    rows = [(d, i, line, section_of(i)) for d, lines in docs.items() for i, line in enumerate(lines)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc string, line_no int, line string, section string")
    got = {}
    for r in cp.chunk_lines(table, "doc", section="section" if sectioned else None, block_lines=block).collect():
        got.setdefault(r.doc, []).append((r.chunk_index, r.item_section, r.start_line, r.end_line, r.text))
    for d, lines in docs.items():
        length, tabular = np.array([len(x) for x in lines]), np.array([" | " in x for x in lines])
        edges = [0, *(i for i in range(1, len(lines)) if section_of(i) != section_of(i - 1)), len(lines)]
        want = []
        for a, b in zip(edges[:-1], edges[1:]):
            for x, y in packed_ranges(length, tabular, a, b):
                text = "\n".join(lines[x:y]).strip()
                if text:
                    want.append((len(want), section_of(a) if sectioned else scope.UNSECTIONED, x, y, text))
        assert sorted(got.get(d, [])) == want


def test_lines_of_a_long_document_stay_apart(spark):
    lines = spark.range(50_000).select(F.lit(1).alias("doc"), F.col("id").alias("line_no"), F.lit("z" * 40).alias("line"))
    found = cp.chunk_ranges(lines, "doc", block_lines=4096)
    assert found.agg(F.sum(F.col("end_line") - F.col("start_line"))).first()[0] == 50_000
    assert cp.chunk_lines(lines.limit(0), "doc").isEmpty()
    with pytest.raises(ValueError, match="block needs"):
        cp.chunk_ranges(lines, "doc", block_lines=100)
