"""Exact n-gram Jaccard join: count vectors in R-trees, blocked by equal token groups.

A text's set is that of its distinct word n-grams (64-bit hashes). Two texts link when their Jaccard similarity is at least ``num / den``.

1. Of texts with equal sets in a chunk one is a node; the others belong to it.
2. A node's tokens are hashed into K groups, K larger than the number of tokens in which two linked sets of this size can differ: so at least one
   group that either may not leave out is equal in both. Each group's content is a key. (K goes by size level; a node whose partners may fall
   into the next level has keys there too. Groups of one token say little: a node leaves them and the empty ones out if K allows for so many, else it
   has keys for both.)
3. The smallest node of each key is paired with the others: each node first with the one it shares most keys with, then with those it is not yet
   connected to. Verified pairs are joined to components.
4. Keys whose members still lie in different components: there the members' group counts are points of R-trees. The sum of coordinate minima
   bounds the overlap of two points, and with a node's maxima that of any point below it. A large key is cut into blocks of bounded size, and each
   block is paired with each in a task of its own (``cells``). A point has about one coordinate for eight tokens, else the bound says nothing of long
   texts; points of different width are compared at the lesser one, to which the other folds. Pairs across components that survive are verified on
   their texts: first only so many as join a key's components if all hold; where one does not hold, all pairs of the key that are left.
   Only members outside the key's largest component search, since every pair to be found has such a member.

   A key of over ``HOT`` members mostly stands for a passage that unrelated texts have in common. Its members have their rarest tokens as keys
   instead: a text of n tokens so many that no linked text can do without all of them (n - o + 1, where o is the least overlap). All rank tokens by one
   table of counts of these members' tokens, so two linked texts have one of them in common, and the passage's own tokens come last.

After step 4 every pair that can link was verified or already lies in one component, so components are exact, while a group of m near copies costs about m
verifications, not m squared. One R-tree over all texts is not used: coordinates of unrelated texts differ too little for upper nodes to prune.

Edge cases: texts with fewer words than n are one token; null texts and texts without words have an empty set and link with nothing; null doc_ids
take part, but do not name a component unless all its ids are null; rows that repeat a doc_id are nodes of their own; extra columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACED, as_bytes, mix, numbered, partitions, per_text, prefix_hashes, run_hashes, slices, span_hashes, stored, stored_by, tidy, word_spans
from factloom.llm.graph import components

ROW = "_row"
COORDINATES = 128  # at least; a longer text has more, see ``widths``
TOKENS_A_COORDINATE = 8
BLOCK_COORDINATES = 1 << 18
LEAF = 32
LISTED = 16  # of its keys a node carries so many, the smallest
HOT = 128  # keys of more members are replaced by tokens
TALLIES, SEGMENTS = 1 << 17, 32
POINTS = "node long, n long, counts binary"
CHUNK_BYTES = 16 << 20
KEYS, MEMBER, INFO, STAR = 0, 1, 2, 3
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """Words per n-gram, and the least similarity as a fraction."""

    words: int = 5
    num: int = 8
    den: int = 10

    def least_overlap(self, total):
        """Least intersection of linked sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def without_link(self, size):
        """So many tokens of a set of this size, whichever they are: each set linked to it has one of them at least."""
        return size - self.least_overlap(size + -(-self.num * size // self.den)) + 1

    @property
    def levels(self) -> tuple[list[int], list[int], list[int]]:
        return levels(self.num, self.den)


@lru_cache(maxsize=8)
def levels(num: int, den: int) -> tuple[list[int], list[int], list[int]]:
    """Largest size of each level, most differing tokens of a linked pair there, number of groups."""
    tops, differ, groups = [8], [], []
    while tops[-1] < 1 << 40:
        tops.append(tops[-1] * den // num + 1)
    for top in tops:
        d = max(s - 2 * -(-num * s // (num + den)) for s in range(max(2, 2 * top - 2 * (num + den)), 2 * top + 1))
        differ.append(d)
        groups.append(d + 1 + max(2, d // 12))
    return tops, differ, groups


def token_sets(raw: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens and the text of each, ordered by text and token."""
    starts, ends, first = word_spans(raw, offs, SPACED)
    hashes = span_hashes(prefix_hashes(raw, lower=True), starts, ends)
    owner = per_text(first, len(hashes))
    runs = run_hashes(hashes, words)
    inside = owner[: len(runs)] == owner[words - 1 :]
    tokens, texts = [runs[inside]], [owner[: len(runs)][inside]]
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < words)):
        tokens.append(run_hashes(hashes[first[i] : first[i + 1]], int(first[i + 1] - first[i]), seed=1))
        texts.append(np.array([i]))
    token, text = np.concatenate(tokens), np.concatenate(texts)
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    return token[new], text[new]


def group_keys(token: np.ndarray, text: np.ndarray, size: np.ndarray, level: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys at the given level of each text (-1: none), and the text of each key."""
    tops, differ, groups = (np.array(x) for x in rule.levels)
    use = (level >= 0) & (size > 0)
    use[use] = differ[level[use]] > 0
    mine = use[text]
    token, text = token[mine], text[mine]
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = groups[level]
    group = (mix(token ^ np.uint64(0xA5A5)) % k[text].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((group, text))
    group, owner = group[order], text[order]
    head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])))
    content = np.add.reduceat(mix(token[order] + np.uint64(0x51ED)), head)
    owner, group = owner[head], group[head]
    single = np.diff(np.append(head, len(order))) == 1
    place = level[owner].astype(np.uint64) << np.uint64(40) | group.astype(np.uint64)
    keys = mix(content ^ mix(place + np.uint64(1)))
    filled = np.bincount(owner, minlength=len(size))
    spare = np.where(use, k - differ[level] - 1, 0)  # so many equal groups may be left out
    empty = np.where(use, k - filled, 0)
    weak = empty + np.bincount(owner, single, minlength=len(size)).astype(np.int64)
    at = np.searchsorted(owner, np.arange(len(size) + 1))
    gap_keys, gap_owner = [keys[:0]], [owner[:0]]
    for i in np.flatnonzero(use & (empty > spare)):
        gaps = np.setdiff1d(np.arange(k[i]), group[at[i] : at[i + 1]]).astype(np.uint64)
        gap_keys.append(mix((np.uint64(level[i]) << np.uint64(40) | gaps) ^ np.uint64(0xE3F7_0000_0000_0000)))
        gap_owner.append(np.full(len(gaps), i))
    keep = ~single | (weak > spare)[owner]
    keys, owner = np.concatenate([keys[keep], *gap_keys]), np.concatenate([owner[keep], *gap_owner])
    return keys.view(np.int64), owner


def planes(x: np.ndarray) -> bytes:
    """The eight byte planes of 64-bit values one after another: planes of zeros cost nothing once the exchange compresses."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def enter(rule: Rule, n_parts: int):
    """Keys of the nodes, combined within chunks and packed by target partition; and one record for each text.

    Of equal sets in a chunk the first is the node. Of equal keys in a chunk the first is dealt by key; the others are known to share it and
    pass through."""
    tops = np.array(rule.levels[0])
    names = ["deal", "kind", "x", "y", "z", "w"]

    def packed(deal: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        data = [planes(c.view(np.uint64)) for c in columns] + [b""] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array([deal], pa.int32()), pa.array([kind], pa.int8()), *(pa.array([d], pa.binary()) for d in data)], names=names)

    def combined(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, doc, size, s1, s2 = (np.concatenate([f[i] for f in found]) for i in range(5))
        order = np.lexsort((row, s2, s1, size))
        same = np.zeros(len(row), bool)
        same[1:] = (size[order][1:] == size[order][:-1]) & (s1[order][1:] == s1[order][:-1]) & (s2[order][1:] == s2[order][:-1])
        node = np.empty(len(row), np.int64)
        node[order] = row[order][~same][np.cumsum(~same) - 1]
        for at in range(0, len(row), 1 << 13):
            part = slice(at, at + (1 << 13))
            yield packed(int(row[at] % n_parts), INFO, row[part], doc[part], size[part], node[part])
        keys, owner = np.concatenate([f[5] for f in found]), np.concatenate([f[6] for f in found])
        heads = np.sort(row[order][~same])
        mine = heads[np.minimum(np.searchsorted(heads, owner), len(heads) - 1)] == owner
        keys, owner = keys[mine].view(np.uint64), owner[mine]
        deal = (keys >> np.uint64(32)) % np.uint64(n_parts)
        order = np.lexsort((owner, keys, deal))
        keys, owner, deal = keys[order], owner[order], deal[order]
        head = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        at = np.flatnonzero(head)
        run = np.diff(np.append(at, len(keys)))
        first = np.repeat(owner[at], run)
        others = np.flatnonzero(~head)
        for x in range(0, len(others), 1 << 16):
            part = others[x : x + (1 << 16)]
            yield packed(int(owner[part[0]] % n_parts), MEMBER, keys[part].view(np.int64), owner[part], first[part])
        keys, owner, deal, shared = keys[at], owner[at], deal[at], run > 1
        cut = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))[: len(keys)]
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist()):
            base = owner[i:j].min()
            yield packed(
                int(deal[i]), KEYS, np.diff(keys[i:j], prepend=np.uint64(0)), ((owner[i:j] - base) << 1) | shared[i:j], np.array([base]),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, read = [], 0
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            docs, rows = batch.column("doc").to_numpy(), batch.column(ROW).to_numpy()
            for a, b, part, at in slices(raw, offs):
                token, text = token_sets(part, at, rule.words)
                size = np.bincount(text, minlength=b - a)
                sums = np.zeros((2, b - a), np.uint64)
                head = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
                for i, seed in enumerate((0x1234567, 0x89ABCDEF)):
                    if len(head):
                        sums[i, text[head]] = np.add.reduceat(mix(token + np.uint64(seed)), head)
                sums[0, size == 0] = rows[a:b][size == 0]
                low = np.searchsorted(tops, size)
                high = np.searchsorted(tops, size * rule.den // rule.num)
                keyed = [group_keys(token, text, size, x, rule) for x in (low, np.where(high > low, high, -1))]
                keys, owner = (np.concatenate(x) for x in zip(*keyed))
                found.append((rows[a:b], docs[a:b], size, *sums, keys, rows[a + owner]))
                read += len(part)
                if read >= CHUNK_BYTES:
                    yield from combined(found)
                    found, read = [], 0
        if found:
            yield from combined(found)
        found.clear()
        tidy()

    return run


def share_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the keys that three or more nodes may share, each with the key's smallest node; for all shared keys the pairs of smallest node and other
    member with their number of keys; records of texts pass through."""
    names = ["kind", "x", "y", "z", "w"]

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        columns = [*columns, *[np.zeros(len(columns[0]), np.int64)] * (4 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *(pa.array(c.view(np.int64)) for c in columns)], names=names)

    found = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] != KEYS:
                columns = [from_planes(r[c]) for c in "xyzw" if r[c]]
                yield out(r["kind"], *columns)
                if r["kind"] == MEMBER:
                    yield out(STAR, columns[2], columns[1], np.ones(len(columns[1]), np.int64))
                continue
            node = from_planes(r["y"])
            found.append((np.cumsum(from_planes(r["x"])), (node >> np.uint64(1)).view(np.int64) + from_planes(r["z"]).view(np.int64)[0], (node & np.uint64(1)).astype(bool)))
    if not found:
        return
    keys, node, shared = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((node, keys))
    keys, node, shared = keys[order], node[order], shared[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    run = np.diff(np.append(head, len(keys)))
    first, any_shared = np.repeat(node[head], run), np.logical_or.reduceat(shared, head)
    other = node != first
    pairs, count = np.unique(np.stack([first[other], node[other]]), axis=1, return_counts=True)
    yield out(STAR, pairs[0], pairs[1], count)
    several = np.repeat((run > 2) | any_shared, run)
    yield out(MEMBER, keys[several], node[several], first[several])


def tally(token: np.ndarray) -> np.ndarray:
    """Place of tokens in the table of counts."""
    return (mix(token ^ np.uint64(0x7A11)) % np.uint64(TALLIES)).astype(np.int64)


def count_tokens(words: int):
    """The table of counts over the texts of a task, in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TALLIES, np.int64)
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            for *_, part, at in slices(raw, offs):
                held += np.bincount(tally(token_sets(part, at, words)[0]), minlength=TALLIES)
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([planes(x) for x in np.split(held, SEGMENTS)], pa.binary())], names=["segment", "counts"])

    return run


def sum_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
            total[segment] = total.get(segment, np.uint64(0)) + from_planes(counts)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([planes(x) for x in total.values()], pa.binary())], names=["segment", "counts"])


def rarest(rule: Rule, shared):
    """Keys of texts: the rarest of their tokens by the broadcast table of counts, so many that two linked texts have one in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            nodes = batch.column("node").to_numpy()
            for a, b, part, at in slices(raw, offs):
                token, text = token_sets(part, at, rule.words)
                size = np.bincount(text, minlength=b - a)
                order = np.lexsort((token, shared.value[tally(token)], text))
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                kept = order[place < rule.without_link(size)[text]]
                yield pa.RecordBatch.from_arrays([pa.array(mix(token[kept] ^ np.uint64(0x4A7E)).view(np.int64)), pa.array(nodes[a + text[kept]])], names=["key", "node"])
        tidy()

    return run


def rare_keys(texts: DataFrame, rule: Rule) -> DataFrame:
    """Of ``texts`` (node, text): their rarest tokens as keys (key, node)."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(count_tokens(rule.words), "segment int, counts binary").repartition(SEGMENTS, "segment")
    counts = np.zeros((SEGMENTS, TALLIES // SEGMENTS), np.uint64)
    for row in counted.mapInArrow(sum_segments, "segment int, counts binary").collect():
        counts[row["segment"]] = from_planes(row["counts"])
    return stored(texts.mapInArrow(rarest(rule, spark.sparkContext.broadcast(counts.ravel())), "key long, node long"), "rare")


def widths(size: np.ndarray) -> np.ndarray:
    """Number of coordinates of texts with so many tokens: a power of two, so that the points of two widths fold to the lesser."""
    need = np.maximum(-(-np.asarray(size, np.int64) // TOKENS_A_COORDINATE), COORDINATES)
    return 1 << np.ceil(np.log2(need)).astype(np.int64)


def compact(counts: np.ndarray) -> bytes:
    """Counts of a point in 4, 8 or 32 bits each, the least that the largest fits in; the first byte says which."""
    top = counts.max(initial=0)
    if top < 16:
        return b"\x04" + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return b"\x08" + counts.astype(np.uint8).tobytes() if top < 256 else b"\x20" + counts.astype("<i4").tobytes()


def coordinates(point: bytes) -> int:
    """How many counts a point has."""
    return (len(point) - 1) * 8 // point[0]


def points(words: int):
    """Set size and group counts of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = as_bytes(batch.column("text"))
            for a, b, part, at in slices(raw, offs):
                token, text = token_sets(part, at, words)
                size = np.bincount(text, minlength=b - a)
                width = widths(size)
                edge = np.append(0, np.cumsum(width))
                slot = (mix(token + np.uint64(77)) % width[text].astype(np.uint64)).astype(np.int64)
                counts = np.bincount(edge[text] + slot, minlength=edge[-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("node")[a:b], pa.array(size), pa.array([compact(c) for c in np.split(counts, edge[1:-1])], pa.binary()),
                ], names=["node", "n", "counts"])

    return run


def vectors(counts: list[bytes], width: int) -> np.ndarray:
    """Points of at least this width, folded to it."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(counts):
        shapes.setdefault((c[0], len(c)), []).append(i)
    out = np.empty((len(counts), width), np.int32)
    for (bits, size), at in shapes.items():
        values = np.frombuffer(b"".join([counts[i] for i in at]), np.uint8).reshape(len(at), size)[:, 1:]
        if bits == 4:
            values = np.stack([values & 15, values >> 4], 2)
        elif bits == 32:
            values = np.ascontiguousarray(values).view("<i4")
        out[at] = values.reshape(len(at), -1, width).sum(1)
    return out


def overlap_bound(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Bound of the overlap of each pair of points."""
    width = np.array([min(coordinates(a), coordinates(b)) for a, b in zip(first, second)], np.int64)
    out = np.zeros(len(first), np.int64)
    for w in np.unique(width).tolist():
        same = np.flatnonzero(width == w)
        for at in np.array_split(same, max(1, len(same) * w >> 20)):
            a, b = (vectors([side[i] for i in at.tolist()], w) for side in (first, second))
            out[at] = np.minimum(a, b).sum(1)
    return out


def within_bound(rule: Rule):
    """May two points belong to linked texts?"""

    @F.arrow_udf("boolean")
    def may(na: pa.Array, nb: pa.Array, ca: pa.Array, cb: pa.Array) -> pa.Array:
        both = overlap_bound(ca.to_pylist(), cb.to_pylist())
        return pa.array(both >= rule.least_overlap(na.to_numpy(zero_copy_only=False) + nb.to_numpy(zero_copy_only=False)))

    return may


def verifier(rule: Rule):
    """Exact test of two texts."""

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def sets(texts: pa.Array) -> list[np.ndarray]:
            raw, offs = as_bytes(texts)
            out = []
            for a, b, part, at in slices(raw, offs):
                token, text = token_sets(part, at, rule.words)
                out += np.split(token, np.searchsorted(text, np.arange(1, b - a)))
            return out

        for left, right in batches:
            got = []
            for at in range(0, len(left), 4096):
                # A text is in several pairs: each is hashed once.
                ones, others = (side.slice(at, 4096).dictionary_encode() for side in (left, right))
                firsts, seconds = sets(ones.dictionary), sets(others.dictionary)
                for i, j in zip(ones.indices.to_pylist(), others.indices.to_pylist()):
                    a, b = firsts[i], seconds[j]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    got.append(bool(both and rule.den * both >= rule.num * (len(a) + len(b) - both)))
            yield pa.array(got, pa.bool_())
        tidy()

    return linked


class Tree:
    """R-tree of points packed by size: leaves of ``LEAF`` points, then nodes of eight; each node keeps coordinate maxima and the least and largest size."""

    def __init__(self, counts: np.ndarray, size: np.ndarray, rule: Rule):
        self.counts, self.size, self.rule = counts, size, rule
        self.order = np.lexsort((counts[:, 0], size))
        at = np.arange(0, len(size), LEAF)
        level = (np.maximum.reduceat(counts[self.order], at), size[self.order][at], size[self.order][np.append(at[1:], len(size)) - 1])
        self.levels = [level]
        while len(level[0]) > 8:
            at = np.arange(0, len(level[0]), 8)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def search(self, n: int, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points whose overlap bound with a point of n tokens reaches what the two sizes require, and that bound."""
        rule = self.rule
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, small, big = (x[nodes] for x in self.levels[depth])
            fits = (rule.num * small <= rule.den * n) & (rule.num * n <= rule.den * big)
            fits &= np.minimum(top, point).sum(1) >= rule.least_overlap(n + small)
            nodes = nodes[fits]
            if depth:
                nodes = (nodes[:, None] * 8 + np.arange(8)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        inside = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        found = self.order[inside[inside < len(self.order)]]
        bound = np.minimum(self.counts[found], point).sum(1)
        good = bound >= rule.least_overlap(n + self.size[found])
        return found[good], bound[good]


class Owners:
    """Which pairs of rows belong to their key: those that have no smaller key in common, as far as the rows list their keys."""

    def __init__(self, keys: pa.ListArray):
        self.start, self.flat = keys.offsets.to_numpy(), keys.values.to_numpy()

    def own(self, first: np.ndarray, second: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        pairs, keys = [], []
        for side in (first, second):
            sizes = self.start[side + 1] - self.start[side]
            pair = np.repeat(np.arange(len(side)), sizes)
            value = self.flat[np.arange(len(pair)) + np.repeat(self.start[side] - (np.cumsum(sizes) - sizes), sizes)]
            smaller = value < key[pair]
            pairs.append(pair[smaller])
            keys.append(value[smaller])
        pair, value = np.concatenate(pairs), np.concatenate(keys)
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        out[pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])]] = False
        return out

    def settled(self, at: int, n: int, key: int) -> np.ndarray:
        """Which of n rows list the smaller key that most of them list: no pair of two of these is this key's."""
        value = self.flat[self.start[at] : self.start[at + n]]
        row = np.repeat(np.arange(n), np.diff(self.start[at : at + n + 1]))
        row, value = row[value < key], value[value < key]
        out = np.zeros(n, bool)
        if len(value):
            smaller, which, count = np.unique(value, return_inverse=True, return_counts=True)
            out[row[which == count.argmax()]] = True
        return out


def group_pairs(
    counts: list[bytes], size: np.ndarray, root: np.ndarray, side: np.ndarray, rule: Rule, exhaust: bool,
    mine_alone=lambda i, found: np.ones(len(found), bool), settled: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across roots to verify, of two blocks (sides 1 and 2) only those across them, and only those that are this key's; none between two rows that
    are ``settled``. Unless ``exhaust``, pairs that would only join what the pairs before join are left for a later round.

    Points of one width form a tree. Rows of the largest root (or the settled ones, if more) do not search: the others find them. Points near the mean of
    those that search go first: the text that the others are copies of joins them all."""
    label = np.unique(root, return_inverse=True)[1]
    left = label.max() + 1
    width = np.array([coordinates(c) for c in counts], np.int64)
    idle = label == np.bincount(label).argmax()
    if settled is not None and settled.sum() > idle.sum():
        idle = settled
    one_block = not side.any()
    # Of two blocks the rows of one search the other; then those of the other search the first one's idle rows, which did not.
    ways = [(~idle, np.ones(len(size), bool))] if one_block else [(~idle & (side == 1), side == 2), (~idle & (side == 2), idle & (side == 1))]
    for asking, held in ways:
        for wa in np.unique(width[asking]).tolist():
            for wh in np.unique(width[held]).tolist():
                a, h = np.flatnonzero(asking & (width == wa)), np.flatnonzero(held & (width == wh))
                if one_block and wh < wa:
                    h = h[idle[h]]
                if not len(h) or rule.den * size[a].max() < rule.num * size[h].min() or rule.den * size[h].max() < rule.num * size[a].min():
                    continue
                mine, theirs = (vectors([counts[i] for i in x.tolist()], min(wa, wh)) for x in (a, h))
                tree = Tree(theirs, size[h], rule)
                for at in np.argsort(np.abs(mine - mine.mean(0)).sum(1), kind="stable").tolist():
                    if left == 1:
                        return
                    i = a[at]
                    found, bound = tree.search(size[i], mine[at])
                    found = h[found]
                    other = label[found] != label[i]
                    found, bound = found[other], bound[other]
                    if len(found):
                        own = mine_alone(i, found)
                        found, bound = found[own], bound[own]
                    if exhaust:
                        if one_block and wa == wh:
                            found = found[idle[found] | (found > i)]
                        yield np.minimum(i, found), np.maximum(i, found)
                        continue
                    found = found[np.argsort(-bound, kind="stable")]
                    _, once = np.unique(label[found], return_index=True)
                    yield np.full(len(once), i), found[once]
                    joined = np.isin(label, label[found])
                    left -= len(once)
                    label[joined] = label[i]


def candidates(rule: Rule, exhaust: bool):
    """Sorted by cell: pairs of nodes of different components that survive the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm.suffix_dedup import by_groups

        for batch in by_groups(batches, "cell"):
            cell, key, node, root, size, side = (batch.column(c).to_numpy() for c in ("cell", "key", "node", "root", "n", "side"))
            counts = batch.column("counts").to_pylist()
            owners = Owners(batch.column("keys"))
            head = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])))
            sizes = np.diff(np.append(head, len(key)))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                of, a, b = (np.concatenate(x) for x in zip(*found))
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])

            at = head[sizes == 2]
            for x in range(0, len(at), 1 << 14):
                c, d = at[x : x + (1 << 14)], at[x : x + (1 << 14)] + 1
                apart = (root[c] != root[d]) & ((side[c] == 0) | (side[c] != side[d]))
                c, d = c[apart], d[apart]
                good = overlap_bound([counts[i] for i in c.tolist()], [counts[i] for i in d.tolist()]) >= rule.least_overlap(size[c] + size[d])
                c, d = c[good], d[good]
                mine = owners.own(c, d, key[c])
                found.append((key[c[mine]], node[c[mine]], node[d[mine]]))
            for at, g in zip(head[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                part, here = slice(at, at + g), at

                def mine_alone(i: int, others: np.ndarray) -> np.ndarray:
                    return owners.own(np.full(len(others), here + i), here + others, np.full(len(others), key[here]))

                for i, j in group_pairs(counts[part], size[part], root[part], side[part], rule, exhaust, mine_alone, owners.settled(at, g, key[at])):
                    if len(i):
                        found.append((np.full(len(i), key[at]), node[at + i], node[at + j]))
                        held += len(i)
                    if held > 1 << 16:
                        yield flush()
                        held = 0
            if found:
                yield flush()
        tidy()

    return run


def cells(placed: DataFrame) -> DataFrame:
    """``placed`` (key, node, blocks and more) with cell and side: once for each block of its key that the node's own block is paired with.

    A key of one block is one cell, side 0. Else a cell holds two blocks, sides 1 and 2, or one block alone, side 0: no task gets more of a key than two blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    paired = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(lo == hi, 0).when(F.col("own") == lo, 1).otherwise(2).cast("byte")
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi))
    return paired.select("*", cell.alias("cell"), side.alias("side")).drop("own", "other", "blocks")


def join(documents: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: row, doc, n_shingles, class_id (a row with an equal set), root (smallest row of the component),
    component_id (smallest doc_id of the component). ``row`` is a running number that is stored with the texts before its first use."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return join_numbered(numbered(documents.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text")), "numbered", ROW), rule)


def join_numbered(rows: DataFrame, rule: Rule) -> DataFrame:
    """``join`` of stored rows (number, doc, text)."""
    n_parts = partitions(rows.sparkSession)
    entered = rows.mapInArrow(enter(rule, 3 * n_parts), "deal int, kind byte, x binary, y binary, z binary, w binary")
    entered = stored(entered.repartition(n_parts, "deal").mapInArrow(share_keys, "kind byte, x long, y long, z long, w long"), "keys")
    known = entered.where(F.col("kind") == INFO).select(F.col("x").alias("row"), F.nullif("y", F.lit(NO_ID)).alias("doc"), F.col("z").alias("n"), F.col("w").alias("node"))
    keyed = entered.where(F.col("kind") == MEMBER).select(F.col("x").alias("key"), F.col("y").alias("node"), F.col("z").alias("a"))
    stars = entered.where(F.col("kind") == STAR).select(F.col("x").alias("a"), F.col("y").alias("node"), F.col("z").alias("count"))
    involved = stars.select(F.explode(F.array("a", "node")).alias("node")).distinct()
    dealt = rows.select(F.col(ROW).alias("node"), "text").repartition(n_parts, "node")
    texts = stored_by(dealt.join(involved, "node", "left_semi"), "texts", "node")
    located = stored(texts.mapInArrow(points(rule.words), POINTS), "points")
    linked, may = verifier(rule), within_bound(rule)

    def verified(pairs: DataFrame, bounded: bool) -> DataFrame:
        if not bounded:
            first, second = (located.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}")) for c in "ab")
            pairs = pairs.join(second, "b").join(first, "a").where(may("na", "nb", "ca", "cb")).select("a", "b")
        first, second = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        # A text that many others face is the first: their pairs part again for the second.
        both = pairs.join(first, "a").join(second, "b")
        return stored(both.select("a", "b", linked("ta", "tb").alias("good")), "verified")

    stars = stored(stars.groupBy("a", "node").agg(F.sum("count").alias("count")), "stars")
    best = stars.groupBy("node").agg(F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), F.col("node").alias("b"))
    tested = verified(best, False)
    roots = components(tested.where("good").select(F.col("a").alias("u"), F.col("b").alias("v")))
    apart = stars.select("a", F.col("node").alias("b"))
    for end in "ab":
        apart = apart.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = tested.unionByName(verified(apart, False))
    roots = components(tested.where("good").select(F.col("a").alias("u"), F.col("b").alias("v")))

    def across(members: DataFrame) -> DataFrame:
        """``members`` of keys whose members can face each other across components, with size and root."""
        placed = members.join(roots, "node", "left").join(located.select("node", "n"), "node").select("key", "node", "a", "n", F.coalesce("root", "node").alias("root"))
        # Where all members were paired with one head, only the others can face each other.
        other = F.when(F.col("node") != F.col("a"), F.col("root"))
        need = F.greatest(F.lit(COORDINATES), F.ceil(F.col("n") / TOKENS_A_COORDINATE))
        blocks = F.ceil(F.sum(F.pow(F.lit(2.0), F.ceil(F.log2(need)))) / BLOCK_COORDINATES).cast("long")
        crossed = placed.groupBy("key").agg(
            blocks.alias("blocks"), F.count("*").alias("members"),
            (F.min("a") == F.max("a")).alias("one"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(other).alias("other_lo"), F.max(other).alias("other_hi"),
        ).where(F.when(F.col("one"), F.col("other_lo") < F.col("other_hi")).otherwise(F.col("lo") < F.col("hi"))).select("key", "one", "blocks", "members")
        return placed.join(crossed, "key")

    faced = stored(across(keyed), "faced")
    hot_nodes = stored(faced.where(F.col("members") > HOT).select("node").distinct(), "hot")
    if not hot_nodes.isEmpty():
        rare = rare_keys(texts.join(hot_nodes, "node", "left_semi"), rule).withColumn("a", F.lit(-1).cast("long"))
        faced = faced.where(F.col("members") <= HOT).unionByName(stored(across(rare), "faced"))
    doubtful = None
    for exhaust in (False, True):
        crossing = faced if doubtful is None else across(faced.select("key", "node", "a").join(doubtful, "key", "left_semi"))
        facing = crossing.where("not one or node != a").select("key", "node", "root", "n", "blocks")
        least = facing.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LISTED).alias("keys"))
        # Of the keys listed only those before the row's own decide whose a pair is.
        listed = facing.join(least, "node").withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
        facing = listed.join(located.select("node", "counts"), "node").select("key", "node", "root", "n", "counts", "blocks", "keys")
        facing = cells(facing).repartition(n_parts, "cell").sortWithinPartitions("cell", "key", "node")
        found = stored(facing.mapInArrow(candidates(rule, exhaust), "key long, a long, b long"), "found")
        tested = tested.unionByName(verified(found.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), True))
        good = tested.where("good").select("a", "b")
        doubtful = stored(found.join(good, ["a", "b"], "left_anti").select("key").distinct(), "doubtful")
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(good.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        if doubtful.isEmpty():
            break
    placed = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    return placed.join(names, "root").select("row", "doc", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), "root", "component_id")


def keep_one(documents: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the row of the smallest doc_id of each component (the first such row in table order)."""
    documents = numbered(documents, "numbered", ROW)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    joined = join_numbered(documents.select(ROW, doc.alias("doc"), F.col(text_col).cast("string").alias("text")), rule)
    best = joined.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("best")).select(F.col("best.row").alias(ROW))
    return documents.join(best, ROW, "left_semi").drop(ROW)
