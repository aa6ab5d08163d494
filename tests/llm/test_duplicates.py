"""N-gram join, suffix dedup, components, fingerprints."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, fingerprints, lm_scoring, ngram_join, suffix_dedup
from factloom.llm.graph import components
from tests.llm.helpers import documents, linked_components, near_copies, odd_rows, repeats, shingles, words


@pytest.mark.parametrize("rule", [ngram_join.Rule(4, 85, 100), ngram_join.Rule(), ngram_join.Rule(2, 6, 10)])
def test_join_against_all_pairs(spark, rule):
    rows = near_copies(3, 400)
    want = linked_components(rows, rule.words, rule.num, rule.den)
    got = {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows, 5), rule).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("tokens", [8, 1])
def test_join_of_keys_in_blocks(spark, monkeypatch, tokens):
    monkeypatch.setattr(ngram_join, "BLOCK_COORDINATES", 512)
    monkeypatch.setattr(ngram_join, "COORDINATES", 4)
    monkeypatch.setattr(ngram_join, "TOKENS_A_COORDINATE", tokens)
    rule = ngram_join.Rule(2, 6, 10)
    rows = near_copies(6, 300, 12)
    want = linked_components(rows, rule.words, rule.num, rule.den)
    got = {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows, 5), rule).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("hot", [2, 5])
def test_join_with_tokens_for_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rule = ngram_join.Rule(2, 6, 10)
    rows = near_copies(9, 300, 12)
    want = linked_components(rows, rule.words, rule.num, rule.den)
    got = {r.doc: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows, 5), rule).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_common_passage_makes_no_large_key(spark, monkeypatch):
    """Unrelated texts with a passage in common, each sixth of them with a near copy."""
    faced, cells = [], ngram_join.cells
    monkeypatch.setattr(ngram_join, "cells", lambda placed: faced.append(placed.groupBy("key").count().agg(F.max("count")).first()[0]) or cells(placed))
    r = random.Random(2)
    passage, rows = [f"common{i}" for i in range(45)], []
    for i in range(1200):
        own = [f"w{r.randrange(1 << 30)}" for _ in range(45)]
        rows.append((len(rows), " ".join(own + passage)))
        if i % 6 == 0:
            own[r.randrange(45)] = "other"
            rows.append((len(rows), " ".join(own + passage)))
    got = {row.doc: row.component_id for row in ngram_join.join(documents(spark, rows, 5)).collect()}
    assert max(x or 0 for x in faced) <= 128
    texts = [t.split() for _, t in rows]
    want = [i - 1 if i and len(set(texts[i]) & set(texts[i - 1])) > 80 else i for i in range(len(rows))]
    assert [got[i] for i in range(len(rows))] == want and sum(i != w for i, w in enumerate(want)) == 200


@pytest.mark.parametrize("rule", [ngram_join.Rule(4, 85, 100), ngram_join.Rule(), ngram_join.Rule(2, 6, 10)])
def test_linked_sets_share_one_of_the_tokens_taken(rule):
    for n in range(1, 200):
        taken = rule.without_link(n)
        linked = [m for m in range(1, 2 * n) if rule.den * min(n, m) >= rule.num * max(n, m)]
        assert 1 <= taken <= n and all(n - taken < rule.least_overlap(n + m) for m in linked)


def test_rows_of_the_largest_component_do_not_search(monkeypatch):
    r, rule, asked = np.random.default_rng(5), ngram_join.Rule(1), []
    search = ngram_join.Tree.search
    monkeypatch.setattr(ngram_join.Tree, "search", lambda self, n, point: asked.append(n) or search(self, n, point))
    base = r.integers(0, 1 << 40, 60)
    texts = [" ".join(map(str, [*base[:58], i, -i])) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(200), pa.int64()), "text": pa.array(texts)})
    out = pa.Table.from_batches(ngram_join.points(rule.words)([batch]))
    counts, size, root = out.column("counts").to_pylist(), out.column("n").to_numpy(), np.array([0] * 196 + [1, 1, 2, 3])
    for side in (np.zeros(200, np.int8), np.array([1, 2] * 100, np.int8)):
        asked.clear()
        got = [(int(i), int(j)) for a, b in ngram_join.group_pairs(counts, size, root, side, rule, True) for i, j in zip(a, b)]
        assert len(asked) == 4
        assert sorted(got) == [(i, j) for i in range(200) for j in range(i + 1, 200) if root[i] != root[j] and (not side.any() or side[i] != side[j])]


def test_rows_that_list_a_smaller_key_are_settled():
    owners = ngram_join.Owners(pa.array([[1, 4], [9], [4, 5], [], [2, 4]], pa.list_(pa.int64())))
    assert owners.settled(0, 5, 7).tolist() == [True, False, True, False, True]
    assert owners.settled(1, 3, 4).tolist() == [False] * 3


def test_hot_key_is_dealt_over_cells(spark):
    n, blocks = 3000, 6
    placed = spark.range(n).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.lit(blocks).cast("long").alias("blocks"))
    got = ngram_join.cells(placed).collect()
    sizes, members = Counter(r.cell for r in got), {}
    for r in got:
        members.setdefault(r.cell, {}).setdefault(r.side, []).append(r.node)
    assert len(sizes) == blocks * (blocks + 1) // 2 and max(sizes.values()) < 2 * 1.25 * n / blocks
    met = np.zeros((n, n), np.int64)
    for sides in members.values():
        if 0 in sides:
            assert set(sides) == {0}
            met[np.ix_(sides[0], sides[0])] += 1
        else:
            met[np.ix_(sides[1], sides[2])] += 1
            met[np.ix_(sides[2], sides[1])] += 1
    assert (met == 1).all()


@pytest.mark.parametrize("side", [0, 1])
def test_long_unrelated_texts_are_pruned(side):
    r, rule = np.random.default_rng(3), ngram_join.Rule()
    texts = [" ".join(map(str, r.integers(0, 1 << 40, n))) for n in (8000, 8000, 8000, 8100, 17000)]
    copy = texts[0].split()
    copy[100:110] = "a b c d e f g h i j".split()
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(6), pa.int64()), "text": pa.array([*texts, " ".join(copy)])})
    out = pa.Table.from_batches(ngram_join.points(rule.words)([batch]))
    sides = np.array([0, 0, 0, 0, 0, 0] if not side else [1, 1, 2, 2, 1, 2], np.int8)
    pairs = [(int(i), int(j)) for a, b in ngram_join.group_pairs(out.column("counts").to_pylist(), out.column("n").to_numpy(), np.arange(6), sides, rule, True) for i, j in zip(a, b)]
    assert pairs == [(0, 5)]


def test_keep_one_is_one_of_each_component(spark):
    rows = near_copies(4, 200)
    want = {root for _, root in linked_components(rows, 5, 8, 10)}
    kept = ngram_join.keep_one(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == want


def test_join_odd_rows(spark):
    got = ngram_join.join(documents(spark, odd_rows()), ngram_join.Rule(4, 85, 100)).collect()
    by_doc = {r.doc: r for r in got if r.doc is not None}
    assert len(got) == len(odd_rows())
    assert by_doc[1].n_shingles == by_doc[2].n_shingles == by_doc[3].n_shingles == 0
    assert {by_doc[i].component_id for i in (1, 2, 3, 4)} == {1, 2, 3, 4}
    assert by_doc[9].component_id == 5 == by_doc[5].component_id
    assert all(r.n_shingles == len(shingles(t, 4)) for r, t in ((by_doc[i], t) for i, t in odd_rows() if i))
    assert ngram_join.join(documents(spark, []), ngram_join.Rule()).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (300, 100), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("few", "many", "depth", "gram"), [(64, 256, 20, 8), (1, 2, 20, 8), (64, 256, 30, 6)])
def test_repeats_against_all_windows(spark, monkeypatch, few, many, depth, gram):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    r = random.Random(5)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 300))) for _ in range(20)]
    rows = []
    for i in range(200):
        k, a, b = r.random(), r.choice(base), r.choice(base)
        text = a if k < 0.3 else a[: r.randint(0, len(a))] + "X" + b[r.randint(0, len(b)) :] if k < 0.6 else "ab" * r.randint(0, 100) if k < 0.7 else "a line that many have " + str(i)
        rows.append((i, text))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(documents(spark, rows, 4), depth=depth, gram=gram).collect()}
    assert [got[i] for i in range(len(rows))] == repeats(rows, depth)


def test_repeats_odd_rows(spark):
    rows = sorted(odd_rows(), key=lambda x: (x[0] is not None, x[0] or 0))
    df = documents(spark, rows, 1).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_bytes")
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, bytes(x.kept)) for x in got) == sorted((str(i), w[0], w[1], w[3]) for (i, _), w in zip(rows, repeats(rows, 100)))
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_anchors_of_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", 12)
    r = random.Random(2)
    a = "".join(r.choice("abcdefgh") for _ in range(9000))
    rows = [(1, a), (2, a[2000:8000] + "zz")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert [got[1], got[2]] == repeats(rows, 100)


def test_fingerprints_in_id_order(spark):
    rows = [(i, f"line {i} " * (i % 7) + "\nsecond line of all\n\n" + "tail " * i) for i in range(60)]
    got = {x.doc_id: x for x in fingerprints.compare_with_edits(documents(spark, rows, 4)).collect()}
    assert len(got) == 60
    texts = dict(rows)
    for i in range(60):
        t, following = texts[i], texts[(i - 1) % 60]
        changed = fingerprints.edited(t, following)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = fingerprints.fingerprints(pa.array([t, changed]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
        assert got[i].near_edited == pytest.approx(fingerprints.likeness(a, b)) and 0 <= got[i].near_next <= 1


def test_fingerprint_tree():
    one = "\n".join(f"paragraph {i} says " + " ".join(f"word{i}x{j}" for j in range(30)) for i in range(20))
    other = one.replace("word7x3 ", "changed ")
    a, same, b, c = fingerprints.fingerprints(pa.array([one, one, other, "something else"]))
    assert a == same and a != b and fingerprints.differing(a, same) == []
    assert fingerprints.likeness(a, b) > 0.9 > fingerprints.likeness(a, c) == 0.0
    spots = fingerprints.differing(a, b)
    assert spots and len(spots) <= 2 and len({(s, p) for s, p, _ in spots}) == 1
    assert fingerprints.fingerprints(pa.array(["a  b", "a b"]))[0] != fingerprints.fingerprints(pa.array(["a  b", "a b"]))[1]


def test_fingerprints_odd_rows(spark):
    got = fingerprints.compare_with_edits(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    alone = fingerprints.compare_with_edits(documents(spark, [(5, "abcd")])).collect()
    assert [(x.doc_id, x.near_next, x.edited_sha256) for x in alone] == [(5, 1.0, hashlib.sha256(b"abab").hexdigest())]
    assert fingerprints.compare_with_edits(documents(spark, [])).count() == 0


@pytest.fixture
def moving_splits(spark, tmp_path, monkeypatch):
    """A table whose splits differ from job to job, as they do when executors come and go: each collect, first and write changes the least number of splits."""
    rows = near_copies(11, 300, 40) + [(i % 5, "same words in all of these rows " * 3) for i in range(40)]
    paths = [str(tmp_path / f"part{i}") for i in range(3)]
    for i, path in enumerate(paths):
        documents(spark, rows[i * 120 : (i + 1) * 120], 1).write.option("parquet.block.size", 1024).parquet(path)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    numbers = [1, 7, 2, 40, 3, 90]

    def moved(f):
        def run(*args, **kwargs):
            numbers.append(numbers.pop(0))
            spark.conf.set("spark.sql.files.minPartitionNum", str(numbers[0]))
            return f(*args, **kwargs)
        return run

    kind, writer = type(spark.range(1)), type(spark.range(1).write)
    for owner, name in ((kind, "collect"), (kind, "first"), (writer, "parquet")):
        monkeypatch.setattr(owner, name, moved(getattr(owner, name)))
    yield rows, spark.read.schema(documents(spark, []).schema).parquet(*paths)
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_keep_their_numbers_when_splits_move(spark, moving_splits):
    rows, df = moving_splits
    numbers = {str(df.select("doc_id", F.monotonically_increasing_id().alias("n")).collect()) for _ in range(6)}
    assert len(numbers) > 1  # the splits do move
    want = Counter(n for n, _ in linked_components(rows, 5, 8, 10))
    joined = ngram_join.join(df).collect()
    assert Counter(r.n_shingles for r in joined) == want and len({r.root for r in joined}) == len({r for _, r in linked_components(rows, 5, 8, 10)})
    kept = Counter(r.text for r in ngram_join.keep_one(df).collect())
    roots = {r for _, r in linked_components(rows, 5, 8, 10)}
    assert sum(kept.values()) == len(roots) == len({r.root for r in joined})
    cut = suffix_dedup.remove_repeats(df, depth=20, gram=8).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in cut) == Counter((i, len(t.encode())) for i, t in rows)
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in cut)
    assert sum(r.n_removed for r in cut) == sum(r.n_removed for r in suffix_dedup.remove_repeats(documents(spark, rows, 3), depth=20, gram=8).collect())
    told = [(r.doc_id, r.fingerprint, r.edited_sha256) for r in fingerprints.compare_with_edits(df).collect()]
    assert Counter(told) == Counter((r.doc_id, r.fingerprint, r.edited_sha256) for r in fingerprints.compare_with_edits(documents(spark, rows, 5)).collect())


def test_scores_keep_their_rows_when_splits_move(spark, moving_splits):
    tokenizers = pytest.importorskip("public_tokenizers")
    rows, df = moving_splits
    file = tokenizers.path("piece_bpe_32k.model")
    got, want = (lm_scoring.score(x, file, block_rows=16).collect() for x in (df, documents(spark, rows, 3)))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in got) == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in want)


def test_fingerprints_of_equal_rows(spark):
    rows = [(3, "c three"), (2, "b two"), (2, "b two"), (2, "b other"), (None, "x"), (None, "x"), (1, "a")] * 3
    got = fingerprints.compare_with_edits(documents(spark, rows, 4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_words_helper():
    assert words("A\tB É") == ["a", "b", "É"]


def test_a_pair_belongs_to_its_smallest_common_key():
    r = random.Random(1)
    lists = [sorted(r.sample(range(12), r.randrange(1, 7))) for _ in range(60)]
    owners = ngram_join.Owners(pa.array(lists, pa.list_(pa.int64())))
    pairs = [(i, j, k) for i in range(60) for j in range(i) for k in range(12)]
    got = owners.own(*(np.array(c) for c in zip(*pairs)))
    want = [not any(x < k for x in set(lists[i]) & set(lists[j])) for i, j, k in pairs]
    assert got.tolist() == want


@pytest.mark.parametrize("top, size", [(15, 65), (255, 129), (70_000, 513)])
def test_points_take_the_fewest_bits_and_fold(top, size):
    counts = np.random.default_rng(5).integers(0, top + 1, 128).astype(np.int32)
    counts[7] = top
    point = ngram_join.compact(counts)
    assert (len(point), ngram_join.coordinates(point)) == (size, 128)
    assert ngram_join.vectors([point, point], 128).tolist() == [counts.tolist()] * 2
    assert ngram_join.vectors([point], 32).tolist() == [counts.reshape(4, 32).sum(0).tolist()]


def test_bucketed_texts_are_joined_without_a_shuffle(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = common.stored_by(spark.range(50).selectExpr("id node", "repeat('x', id) text").repartition(n, "node"), "texts", "node")
    joined = spark.range(20).selectExpr("id a").join(texts.hint("merge"), F.col("a") == F.col("node"))
    assert joined.count() == 20
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
