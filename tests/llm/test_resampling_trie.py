"""Importance resampling and the prefix trie of conversations."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import importance, prefix_trie
from tests.llm.helpers import documents, low, odd_rows

# --- importance resampling -----------------------------------------------------------------


def test_crc_of_spans_of_any_length():
    r = random.Random(1)
    raw = np.frombuffer(r.randbytes(60_000), np.uint8)
    sizes = [1, 2, 31, 32, 33, 63, 64, 65, 96, 1000, 1024, 4097, 20_000]
    spans = [(a, a + n) for n in sizes for a in (0, r.randrange(30_000))]
    got = importance.crc32_spans(raw, *np.array(spans).T)
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in spans]


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def weights(rows, target, most, buckets):
    counts = [[0] * buckets, [0] * buckets]
    for side, texts in enumerate(([t for _, t in rows], target)):
        for text in texts:
            for f in features(text, most)[1]:
                counts[side][zlib.crc32(f.encode()) % buckets] += 1
    s, t = counts
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, found = features(text, most)
        total = [gain[zlib.crc32(f.encode()) % buckets] for f in found]
        weight = sum(total) // len(total) if total else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    return out


def mixed_rows(seed, n=400):
    r = random.Random(seed)
    return [(i if i % 7 else i - i % 3, " ".join(r.choice(["Alpha", "beta", "été", "x" * 40, "y" * 300, "p-q", "7"]) for _ in range(r.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_resampling_against_brute_force(spark, most, buckets):
    rows = mixed_rows(5) + odd_rows() + [(5000, "alpha " * 30)] * 3
    target = ["beta été zeta beta", None, "", "alpha 7 7 7"]
    want = weights(rows, target, most, buckets)
    n = sum(w[4] >= 20 for w in want) * 10 // 100
    best = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))[:n]
    expected = sorted([w[:4] for w in want], key=str), [(*w[:4], k + 1) for k, w in enumerate(best)]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.rank(documents(spark, rows, 6), items, max_words=most, buckets=buckets).collect()
    assert sorted([tuple(g)[:4] for g in got], key=str) == expected[0]
    assert sorted([tuple(g) for g in got if g["rank"]], key=lambda g: g[4]) == expected[1]
    drawn = importance.resample(documents(spark, rows, 6).withColumn("rank", F.lit("old")), items, max_words=most, buckets=buckets)
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, n + 1)) and {"lang", "source", "text", "weight"} <= set(drawn.columns)


def test_drawn_documents_look_like_the_target(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["sea", "ship", "wave"] if i % 10 == 0 else ["corn", "field", "cow"]) for _ in range(40))) for i in range(500)]
    drawn = importance.resample(documents(spark, rows), spark.createDataFrame([("ship wave sea " * 2000,)], "text string"), buckets=50).collect()
    assert len(drawn) == 50 and sum(d.doc_id % 10 == 0 for d in drawn) >= 45


def test_resampling_of_empty_tables(spark):
    none = documents(spark, [(1, "a")]).limit(0)
    words = spark.createDataFrame([("a b",)], "text string")
    assert importance.rank(none, words).collect() == []
    got = importance.rank(documents(spark, [(1, "a " * 20), (2, None)]), words.limit(0)).collect()
    assert [(g.doc_id, g.n_features, g["rank"]) for g in sorted(got)] == [(1, 20, None), (2, 0, None)]  # a tenth of one is none


# --- prefix trie -------------------------------------------------------------------------------
def trie(rows):
    """All nodes by comparing whole prefixes."""
    convs, built, nodes, kids, sums, out = {}, {}, {}, {}, {}, []
    for c, t, role, text in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [(role, text) for _, role, text in sorted(v)] for c, v in convs.items()}
    for c, v in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        built[c] = v if c is None else convs.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    order = lambda c: (c is not None, c or 0)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
        ends = ",".join("null" if c is None else str(c) for c in sorted((c for c in nodes[p] if len(built[c]) == len(p)), key=order))
        parent = min(nodes[p[:-1]], key=order) if p else None
        out.append((min(nodes[p], key=order), len(p), parent, len(nodes[p]), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(spark, rows, parts=5):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "conv_id long, turn long, role string, text string")


def sorted_nodes(nodes):
    return sorted((tuple(n) for n in nodes), key=str)


@pytest.mark.parametrize(("band", "block"), [(16, 4096), (3, 8)])
def test_trie_against_brute_force(spark, monkeypatch, band, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    r = random.Random(4)
    rows = []
    for c in [*range(-20, 100), None]:
        for t in range(r.choice([1, 2, 3, 4, 9, 12, 40])):
            rows.append((c, r.choice([t, t, t, None, t // 2]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, "xx"])))
    rows += [(777, i, "user", f"turn {i}") for i in range(300)]  # one long conversation, in many tasks and bands
    rows += [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]  # many equal ones
    assert sorted_nodes(prefix_trie.trie(talks(spark, rows), band=band).collect()) == sorted_nodes(trie(rows))


def test_parents_of_very_many_nodes_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 2)
    rows = [(5 * c, t, "user", f"{c} {t}") for c in range(40) for t in range(9)] + [(1000, 0, "user", "0 0"), (1000, 1, "user", "other")]
    assert sorted_nodes(prefix_trie.trie(talks(spark, rows)).collect()) == sorted_nodes(trie(rows))


def test_trie_edge_cases(spark):
    assert prefix_trie.trie(talks(spark, [(1, 0, "user", "a")]).limit(0)).collect() == []
    lost = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its family has no head: no turn is left
    for rows in ([(lost, 0, "user", "a")], [(None, None, None, None)], [(lost, 0, "user", "a"), (None, 1, None, "z")]):
        clashing = talks(spark, rows).withColumn("depth", F.lit(9)).withColumn("lo", F.lit(9)).withColumn("conv", F.lit("c"))
        assert sorted_nodes(prefix_trie.trie(clashing).collect()) == sorted_nodes(trie(rows))
