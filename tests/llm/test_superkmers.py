"""Substring dedup by super-k-mers against a comparison of all windows."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from factloom.llm import superkmer_dedup
from tests.llm.helpers import documents, odd_rows

LEAST = -(1 << 63)


def without_repeats(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [LEAST if d is None else d for d, _ in rows]
    first, out = {}, []
    for d, w in zip(ids, split):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    for d, w in zip(ids, split):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def cut(spark, rows, parts=5, **options):
    found = superkmer_dedup.remove_repeats(documents(spark, [(i, t, str(d)) for i, (d, t) in enumerate(rows)], parts).select(
        F.col("doc_id").alias("at"), F.when(F.col("lang") != "None", F.col("lang").cast("long")).alias("doc_id"), "text"), **options)
    return [(r.n_words, r.n_removed, r.kept) for r in sorted(found.collect(), key=lambda r: r["at"])]


def mixed(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([2, 6, 60]))] + ["é", "日本", "x" * 200]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 20, 60, 150]))] for _ in range(15)]
    rows = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        if r.random() < 0.3:
            b = b[: r.randrange(len(b))] + r.choice(base)
        rows.append((r.choice([i, i, i, None, i // 3, 7]), r.choice([" ", "  \n", "\t"]).join(b) + r.choice(["", " "])))
    return rows


# few strings a chunk, many in a bucket, bytes of a chunk and of a part: all ways a window can take
@pytest.mark.parametrize(("few", "many", "chunk", "part", "k", "m"), [
    (8, 4096, 16 << 20, 4 << 20, 13, 3), (1, 4096, 1 << 20, 4 << 20, 13, 3), (8, 2, 500, 300, 13, 3), (8, 4096, 500, 64, 5, 2), (1, 10, 1 << 20, 300, 2, 1),
])
def test_against_all_windows(spark, monkeypatch, few, many, chunk, part, k, m):
    for name, value in (("FEW", few), ("MANY", many), ("CHUNK_BYTES", chunk), ("PART_BYTES", part)):
        monkeypatch.setattr(superkmer_dedup, name, value)
    rows = mixed(few + many + k) + odd_rows() + [(900, "again and " * 40), (901, "again and " * 40)]
    assert cut(spark, rows, k=k, m=m) == without_repeats(rows, k)


def test_common_passage_in_different_surroundings(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join(f"{r.random()}" for _ in range(12)) + " " + passage + " " + " ".join(f"{r.random()}" for _ in range(12))) for i in range(400)]
    got = cut(spark, rows, 7)
    assert [g[1] for g in got] == [0] + [20] * 399 and got == without_repeats(rows, 13)


def test_edge_cases(spark):
    none = documents(spark, [(1, "a")]).limit(0)
    assert superkmer_dedup.remove_repeats(none).collect() == []
    one = documents(spark, [(2, "a b c " * 9), (1, "a b c " * 9), (1, "a b c " * 9)]).withColumns({"kept": F.lit("x"), "_row": F.lit("y"), "row": F.lit("z"), "start": F.lit(1)})
    got = superkmer_dedup.remove_repeats(one).collect()
    assert sorted((g.doc_id, g.n_removed, g["row"], g.start) for g in got) == [(1, 0, "z", 1), (1, 0, "z", 1), (2, 27, "z", 1)]
    with pytest.raises(ValueError):
        superkmer_dedup.remove_repeats(one, k=2, m=3)


# Constants of a module reach Spark's workers only as they stand there, so all ways are tried here without Spark.
def run_tasks(monkeypatch, rows, k, m, bins, batch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(superkmer_dedup, name, value)
    ids = pa.array([LEAST if d is None else d for d, _ in rows])
    table = pa.record_batch([ids, pa.array([t for _, t in rows], pa.string()), pa.array(range(len(rows)))], names=["_doc", "text", "_hash"])
    parts = [table.slice(i, 20) for i in range(0, len(rows), 20)]

    def exchanged(batches, *keys):
        joined = pa.Table.from_batches(batches)
        return joined.take(pc.sort_indices(joined, sort_keys=[(c, "ascending") for c in keys])).combine_chunks().to_batches(batch)

    sent = [b for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]) for b in superkmer_dedup.cut_texts(k, m, bins)(iter(half))]
    judged = list(superkmer_dedup.judge(k)(iter(exchanged(sent, "bin")))) if sent else []
    spans, common = [], 0
    if judged:
        both = pa.Table.from_batches(judged)
        windows = both.filter(pc.equal(both["kind"], superkmer_dedup.DIGEST))
        common = windows.num_rows
        spans += both.filter(pc.equal(both["kind"], superkmer_dedup.SPAN)).to_pylist()
        if common:
            for found in superkmer_dedup.judge_windows(k)(iter(exchanged(windows.to_batches(), "deal", "second", "doc"))):
                spans += found.to_pylist()
    out = [set() for _ in rows]
    for s in spans:
        out[s["row"]].update(range(s["start"], s["end"]))
    return out, common


def test_every_way_of_a_window(monkeypatch):
    common = 0
    for seed in range(16):
        r = random.Random(seed)
        k = r.choice([13, 5, 2, 1])
        rows = mixed(seed, 100) + [(500, None), (501, ""), (502, "  "), (503, "word " * 300), (504, "word " * 20)]
        gone, windows = run_tasks(
            monkeypatch, rows, k, min(k, r.choice([1, 2, 3])), r.choice([1, 5, 40]), r.choice([1, 3, 1000]), FEW=r.choice([1, 8]), MANY=r.choice([2, 10, 4096]),
            CHUNK_BYTES=r.choice([500, 1 << 24]), PART_BYTES=r.choice([64, 300, 1 << 22]), BIN_BYTES=r.choice([200, 1 << 24]), SLICE=r.choice([100, 1 << 20]),
        )
        assert [len(g) for g in gone] == [w[1] for w in without_repeats(rows, k)]
        common += windows
    assert common > 100
