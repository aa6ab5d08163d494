"""Conversation prefix trie: every prefix of turns that conversations share is a node, with sums over its subtree.

Turns get their positions from one exchange by ranges of (conversation, turn, role, start of the text), sorted in place, so a conversation of any length lies in as many tasks as it needs; what a
range must know of those before it is one number. A prefix is named by the XOR of two 64-bit hashes of its (depth, role, text) turns: XOR is associative, so prefixes
are made in bands of ``band`` depths and carried from band to band by the same scan over the bands' sums, blocks of blocks where there are many.
Nodes are an aggregation by (depth, prefix); a node is represented by its smallest member, whose path leads to all its ancestors.

Sums over subtrees are rolled up by depth bands. Inside a band each node adds to its ancestors down to the band's first depth only (``band`` at most), added up first over the new nodes of one
representative. The nodes at the bands' first depths form a smaller tree, ``band`` times less deep, which is rolled up in the same way until one band is left; then the completed totals of
these band roots are added to their ancestors in the band before. A trie of depth d takes log(d) rounds to the base ``band``, and no node is exploded to more than ``band`` rows.

Edge cases: turns are ordered by turn (null first), role and text; null roles and texts are empty; rows without conv_id are one conversation, smaller than all others, named null, that is not rebuilt;
repeated rows are turns of their own; a conversation without turns after rebuilding belongs to the root; an empty table has no node, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import partitions, stored, unsigned_crc32

BAND = 16
BLOCK = 4096  # turns of a conversation, or bands, or ids, that are handled together
HOT = 1000  # parents with more than one in HOT of all nodes as children (fewer than HOT of them) are joined by broadcast
FAMILY, HEADS = 5, 9
NO_ID = -(1 << 63)
KEY = ["depth", "lo", "hi"]


# --- turns in order --------------------------------------------------------------------------
def places_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the task's number, their place in it, and their number within the conversation as far as this task has it."""
    part, at, last, count = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        new = np.append(conv[0] != last, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        local = np.arange(n) - np.where(start < 0, -count, start)
        last, count = int(conv[-1]), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(local)], names=[*batch.schema.names, "part", "place", "local"],
        )
        at += n


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(conv, position from 0, a, b, bytes): a and b are hashes of role and text."""
    turn = F.col("turn").asc_nulls_first()
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = plain.repartitionByRange(partitions(rows.sparkSession), "conv", turn, F.substring("role", 1, 64), F.substring("text", 1, 64))
    hashed = dealt.sortWithinPartitions("conv", turn, "role", "text").select(
        "conv", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("bytes"),
    )
    placed = stored(hashed.mapInArrow(places_in_task, "conv long, a long, b long, bytes long, part int, place long, local long"), "turns")
    edges = placed.groupBy("part").agg(F.min_by("conv", "place").alias("first"), F.max_by("conv", "place").alias("last"), F.max_by("local", "place").alias("end"))
    carried, last, count = [], None, 0
    for e in edges.orderBy("part").collect():  # one row a task
        before = count if e["first"] == last else 0
        if before:
            carried.append((e["part"], e["first"], before))
        count = e["end"] + 1 + (before if e["first"] == e["last"] else 0)
        last = e["last"]
    carry = rows.sparkSession.createDataFrame(carried, "part int, conv long, before long")
    position = F.col("local") + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(carry), ["part", "conv"], "left").select("conv", position.alias("position"), "a", "b", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps: conv, depth from 1, a, b, bytes; conversations: conv, depth) after the first turns were taken from the family's head."""
    known = F.col("conv") != NO_ID
    size = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = size.select("conv", "n", F.when(known, F.col("conv") - F.col("conv") % FAMILY).alias("base"), F.when(known, unsigned_crc32(F.col("conv")) % HEADS).otherwise(0).alias("h"))
    base = size.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").select(
        "conv", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"),
    )
    convs = stored(convs.withColumn("depth", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((F.col("position") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    borrowed = convs.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where(F.col("position") < F.col("taken"))
    # A long conversation meets its one row block by block.
    block = F.floor(F.col("position") / BLOCK).cast("long")
    shifts = convs.where(F.col("n") > F.col("h")).select(
        "conv", "h", (F.col("taken") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long"))).alias("block"),
    )
    own = turns.withColumn("block", block).join(shifts, ["conv", "block"]).where(F.col("position") >= F.col("h"))
    steps = borrowed.select("conv", (F.col("position") + 1).alias("depth"), "a", "b", "bytes").unionByName(
        own.select("conv", (F.col("position") + 1 + F.col("shift")).alias("depth"), "a", "b", "bytes"),
    )
    return steps, convs.select("conv", "depth")


# --- prefixes --------------------------------------------------------------------------------
def band_of(depth: Column, band: int) -> Column:
    return F.floor(depth / band).cast("long")


def carried_xor(sums: DataFrame, last: int) -> DataFrame:
    """(conv, k, lo, hi) with 0 <= k <= last to the XOR of all earlier k; more than BLOCK of a conversation are handled in blocks of their own."""
    block = F.floor(F.col("k") / BLOCK).cast("long")
    before = Window.partitionBy("conv", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = sums.withColumn("block", block).select("conv", "block", "k", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(c) for c in ("lo", "hi")])
    if last < BLOCK:
        return local.drop("block")
    whole = sums.groupBy("conv", block.alias("k")).agg(F.bit_xor("lo").alias("lo"), F.bit_xor("hi").alias("hi"))
    more = carried_xor(whole, last // BLOCK).select("conv", F.col("k").alias("block"), F.col("lo").alias("more_lo"), F.col("hi").alias("more_hi"))
    return local.join(more, ["conv", "block"]).select("conv", "k", F.col("lo").bitwiseXOR(F.col("more_lo")).alias("lo"), F.col("hi").bitwiseXOR(F.col("more_hi")).alias("hi"))


def band_paths(steps: DataFrame, convs: DataFrame, band: int, deepest: int) -> DataFrame:
    """(conv, band, path): the prefixes of a conversation at the depths of a band, as (depth, lo, hi, bytes, lo and hi of the prefix before)."""
    roots = convs.select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", "bytes", "lo", "hi")])
    hashed = steps.select("conv", "depth", "bytes", F.xxhash64("depth", "a", "b").alias("lo"), F.xxhash64(F.lit(3), "b", "depth", "a").alias("hi"))
    every = roots.unionByName(hashed).withColumn("band", band_of(F.col("depth"), band))
    running = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    xored = every.withColumns({"to_lo": F.bit_xor("lo").over(running), "to_hi": F.bit_xor("hi").over(running)})
    local = stored(xored.groupBy("conv", "band").agg(
        F.sort_array(F.collect_list(F.struct("depth", "to_lo", "to_hi", "bytes", "lo", "hi"))).alias("path"), F.bit_xor("lo").alias("all_lo"), F.bit_xor("hi").alias("all_hi"),
    ), "bands")
    sums = local.select("conv", F.col("band").alias("k"), F.col("all_lo").alias("lo"), F.col("all_hi").alias("hi"))
    carry = carried_xor(sums, deepest // band).select("conv", F.col("k").alias("band"), F.col("lo").alias("carry_lo"), F.col("hi").alias("carry_hi"))
    path = F.transform("path", lambda e: F.struct(
        e["depth"].alias("depth"), e["to_lo"].bitwiseXOR(F.col("carry_lo")).alias("lo"), e["to_hi"].bitwiseXOR(F.col("carry_hi")).alias("hi"), e["bytes"].alias("bytes"),
        e["to_lo"].bitwiseXOR(F.col("carry_lo")).bitwiseXOR(e["lo"]).alias("parent_lo"), e["to_hi"].bitwiseXOR(F.col("carry_hi")).bitwiseXOR(e["hi"]).alias("parent_hi"),
    ))
    return stored(local.join(carry, ["conv", "band"]).select("conv", "band", path.alias("path")), "paths")


# --- sums over subtrees ----------------------------------------------------------------------
def rolled_up(paths: DataFrame, own: DataFrame, band: int, deepest: int) -> DataFrame:
    """Totals of leaves and saved over the subtree of each node.

    paths: (conv, band, path of (depth, lo, hi, ...)); own: (depth, lo, hi, conv, leaves, saved), conv being the node's smallest member."""
    mine = own.groupBy("conv", band_of(F.col("depth"), band).alias("band")).agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("mine"))

    def added(entry, what: str) -> Column:
        below = F.filter("mine", lambda m: m["depth"] >= entry["depth"])
        return F.aggregate(below, F.lit(0).cast("long"), lambda total, m: total + m[what])

    shares = paths.join(mine, ["conv", "band"]).select("conv", F.explode(F.transform("path", lambda e: F.struct(
        e["depth"].alias("depth"), e["lo"].alias("lo"), e["hi"].alias("hi"), added(e, "leaves").alias("leaves"), added(e, "saved").alias("saved"),
    ))).alias("e")).select("conv", "e.*")
    inside = shares.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if deepest < band:
        return inside.drop("conv")
    inside = stored(inside, "inside")
    roots = inside.where(F.col("depth") % band == 0).withColumn("depth", band_of(F.col("depth"), band))
    heads = paths.select("conv", F.col("band").alias("depth"), F.col("path")[0]["lo"].alias("lo"), F.col("path")[0]["hi"].alias("hi"))
    shallow = heads.groupBy("conv", band_of(F.col("depth"), band).alias("band")).agg(F.sort_array(F.collect_list(F.struct("depth", "lo", "hi"))).alias("path"))
    totals = rolled_up(shallow, roots, band, deepest // band)
    done = totals.where("depth > 0").join(roots.select(*KEY, "conv"), KEY).select("conv", (F.col("depth") - 1).alias("band"), "leaves", "saved")
    passed = done.join(paths, ["conv", "band"]).select(F.explode("path").alias("e"), "leaves", "saved").select("e.depth", "e.lo", "e.hi", "leaves", "saved")
    return inside.drop("conv").unionByName(passed).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


# --- members that end at a node ----------------------------------------------------------------
def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and chunk: SHA-256 of each node's chunks, joined by commas. Only the digest's state is kept from row to row."""
    key, state = None, None

    def said(keys: list[tuple], hashes: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        keys, hashes = [], []
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if here != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = here, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if keys:
            yield said(keys, hashes)
    if key is not None:
        yield said([key], [state.hexdigest()])


def ending(paths: DataFrame) -> DataFrame:
    """(depth, lo, hi, ends_sha256) of the nodes where conversations end."""
    ends = paths.groupBy("conv").agg(F.max_by(F.element_at("path", -1), "band").alias("e")).select("conv", "e.depth", "e.lo", "e.hi")
    name = F.when(F.col("conv") == NO_ID, F.lit("null")).otherwise(F.col("conv").cast("string"))
    chunk = F.shiftright("conv", 12).alias("chunk")  # 4096 ids at most, in order
    packed = ends.groupBy(*KEY, chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv", name.alias("name")))), lambda m: m["name"]), ",").alias("ids"))
    dealt = packed.repartition(partitions(paths.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.drop("chunk").mapInArrow(digests, "depth long, lo long, hi long, ends_sha256 string")


# --- trie --------------------------------------------------------------------------------------
def with_parents(nodes: DataFrame) -> DataFrame:
    """``parent``: the conversation that represents each node's parent. Parents of very many nodes are few, so they are broadcast; a task never holds one's children."""
    total = nodes.count()
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"), F.col("conv").alias("parent"), "n_children")
    on = ["depth", "parent_lo", "parent_hi"]
    hot = up.where(F.col("n_children") * HOT > total).select(*on, F.col("parent").alias("hot"))  # fewer than HOT rows
    known = nodes.join(F.broadcast(hot), on, "left")
    rest = known.where("hot is null and depth > 0").drop("hot").join(up.drop("n_children"), on)
    return known.where("hot is not null or depth = 0").withColumnRenamed("hot", "parent").unionByName(rest)


def trie(rows: DataFrame, *, band: int = BAND) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per node of the prefix trie of the rebuilt conversations."""
    turns = turns_in_order(rows)
    steps, convs = rebuilt(turns)
    deepest = convs.agg(F.max("depth")).first()[0] or 0
    paths = band_paths(steps, convs, band, deepest)
    entries = paths.select("conv", F.explode("path").alias("e")).select("conv", "e.*")
    nodes = entries.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("parent_lo").alias("parent_lo"), F.min("parent_hi").alias("parent_hi"),
    )
    nodes = stored(nodes, "members")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = nodes.select(*KEY, "conv", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = rolled_up(paths.withColumn("path", F.transform("path", lambda e: F.struct(*[e[c].alias(c) for c in KEY]))), own, band, deepest)
    out = with_parents(nodes).join(totals, KEY).join(ending(paths), KEY, "left")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        shown("conv").alias("conv_id"), "depth", shown("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
