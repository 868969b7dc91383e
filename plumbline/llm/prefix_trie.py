"""The trie of conversation prefixes, grouped exactly only where a count-min sketch cannot rule sharing out.

Every conversation gives a digest for each of its prefixes, chained turn by turn in one streaming pass. A count-min
sketch of all digests is built in the tasks, merged block by block and broadcast; its width is bounded, so its size is
too. An estimate of one proves that no other conversation shares a prefix: such nodes are made where they are found,
without a shuffle. All others are grouped by digest, whatever the sketch says of them, so a crowded sketch costs only
time. No column but the digest, two lengths and the id moves.

Sums over subtrees need no walk over levels. The least member of a node is also the least of all nodes below it that
it belongs to, so each conversation owns the lower part of its path. What a subtree sums to is what its members own of
it: one sum by digest, combined in each task, and a parent shared by all is a row a task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import saved

#: Rows and cells of the sketch; cells are counted up to two. CELLS is the most, 16 MB in all.
ROWS = 2
CELLS = 1 << 23
BLOCK = 1 << 16
#: Parents with more than one in so many of all look-ups are broadcast: at most as many of them.
SHARE = 4096
#: Bytes of joined ids in one block.
ID_BLOCK = 1 << 18
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_ROOT = hashlib.md5(b"root").digest()
_TWICE = np.minimum(np.arange(256), 2).astype(np.uint8)


def pair(digest: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", digest)


def chained(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation from rows (conv, part, place, turn digest, n_chars), dealt by conversation and
    sorted: (conv, depth, hi, lo, parent_hi, parent_lo, n_chars, last). Part -1 is the prefix without a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for conv, part, digest, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part < 0:
                    if held is not None:
                        out.append((*held, True))
                    held = (conv, 0, *pair(_ROOT), 0, 0, 0)
                    state = _ROOT
                else:
                    out.append((*held, False))
                    before = held[2:4]
                    state = hashlib.md5(state + digest).digest()
                    held = (conv, held[1] + 1, *pair(state), *before, n)
            yield record(out)
        if held is not None:
            yield record([(*held, True)])

    names = ["conv", "depth", "hi", "lo", "parent_hi", "parent_lo", "n_chars", "last"]
    kinds = [pa.int64()] * 7 + [pa.bool_()]

    def record(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "part", "digest", "n_chars")
    return dealt.mapInArrow(run, "conv long, depth long, hi long, lo long, parent_hi long, parent_lo long, n_chars long, last boolean")


def cells(hi: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in every row of the sketch."""
    hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
    return np.stack([((hi if k == 0 else lo) % np.uint64(width)).astype(np.int64) + k * width for k in range(ROWS)])


def count_min(paths: DataFrame, prefixes: int) -> np.ndarray:
    """Cells with the number of prefixes that fall there, up to two: built in tasks, merged block by block."""
    width = BLOCK
    while width < min(4 * prefixes, CELLS):
        width *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for row in cells(*(batch.column(k).to_numpy() for k in range(2)), width):
                at, times = np.unique(row, return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(times, 2), 2)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        done = []
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        done.append((now, total.tobytes()))
                    now, total = block, np.zeros(BLOCK, np.uint8)
                total = _TWICE[total + np.frombuffer(counts, np.uint8)]
        if now is not None:
            done.append((now, total.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int32()), pa.array([c for _, c in done], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    tasks = paths.select("hi", "lo").mapInArrow(build, schema).repartition("block").sortWithinPartitions("block")
    sketch = np.zeros(ROWS * width, np.uint8)
    for r in tasks.mapInArrow(merge, schema).collect():  # 16 MB at most
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return sketch


def screened(paths: DataFrame, sketch: np.ndarray) -> DataFrame:
    """The prefixes with `shared` and `parent_shared`: false where the sketch proves that one conversation has them."""
    cast = paths.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in (("hi", "lo"), ("parent_hi", "parent_lo")):
                found = cells(batch.column(a).to_numpy(), batch.column(b).to_numpy(), len(cast.value) // ROWS)
                out.append(pa.array(cast.value[found].min(0) > 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "shared", "parent_shared"])

    schema = paths.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return paths.mapInArrow(run, f"{schema}, shared boolean, parent_shared boolean")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) from (hi, lo, conv): SHA-256 of a node's ids in order, joined by commas.

    Ranges of (node, id) are joined to blocks of text in parallel, then a node's blocks stream through one digest.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, size, first = None, [], 0, 0
        for batch in batches:
            out = []
            for hi, lo, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (hi, lo) != now or size > ID_BLOCK:
                    if texts:
                        out.append((*now, first, ",".join(texts)))
                    now, texts, size, first = (hi, lo), [], 0, conv
                texts.append(str(conv))
                size += len(texts[-1]) + 1
            yield blocked(out)
        yield blocked([(*now, first, ",".join(texts))] if texts else [])

    def blocked(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["hi", "lo", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (hi, lo) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (hi, lo), hashlib.sha256()
                state.update(ids.encode())
            yield digested(out)
        yield digested([(*now, state.hexdigest())] if now is not None else [])

    def digested(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=["hi", "lo", "ends_sha256"])

    ranges = ends.select("hi", "lo", "conv").repartitionByRange("hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv")
    texts = ranges.mapInArrow(blocks, "hi long, lo long, first long, ids string")
    return texts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "ids").mapInArrow(digests, "hi long, lo long, ends_sha256 string")


def parents_of(lookups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The look-ups (with parent_hi, parent_lo) and `parent_conv`, the owner of that node.

    Nodes that own more than one in SHARE of all look-ups as children are at most SHARE, and are broadcast; the others
    are joined by shuffle, and none of them is hot.
    """
    most = lookups.count() // SHARE
    owners = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv").alias("parent_conv"), (F.col("asked") > most).alias("hot"))
    hot = F.broadcast(owners.where("hot").withColumnRenamed("parent_conv", "hot_conv").drop("hot"))
    by = ["parent_hi", "parent_lo"]
    sided = lookups.join(hot, by, "left")
    few = sided.where("hot_conv is not null").withColumnRenamed("hot_conv", "parent_conv")
    rest = sided.where("hot_conv is null").drop("hot_conv").join(owners.where("not hot").drop("hot"), by, "left")
    return few.unionByName(rest)


def prefix_nodes(prefixes: DataFrame, folder: str) -> DataFrame:
    """One row for each node of the trie over (conv long, part, place, digest binary, n_chars).

    Part -1 is a conversation's start, one row each; its turns follow by part and place. Returns conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Work files go to `folder`.
    """
    paths = saved(chained(prefixes), folder, "paths")
    marked = saved(screened(paths, count_min(paths, paths.count())), folder, "screened")
    exact, local = marked.where("shared"), marked.where("not shared")
    both = ["hi", "lo"]

    # one row a node: its least member, and the parent's digest, which is the same for all members
    nodes = exact.groupBy(*both).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("n_chars").alias("n_chars"),
        F.min("parent_hi").alias("parent_hi"), F.min("parent_lo").alias("parent_lo"), F.max("last").alias("ended"),
    )
    nodes = saved(nodes, folder, "nodes")
    tops = local.where("parent_shared")
    children = nodes.where("depth > 0").select("parent_hi", "parent_lo", F.lit(0).alias("top")).unionByName(tops.select("parent_hi", "parent_lo", F.lit(1).alias("top")))
    children = children.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    owned = Window.partitionBy("conv").orderBy(F.desc("depth"))
    nodes = nodes.join(children, both, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("below", F.sum((F.col("n_convs") - 1) * F.col("n_chars")).over(owned))
    nodes = saved(nodes.withColumn("top", F.min("depth").over(Window.partitionBy("conv"))), folder, "owned")

    # what each conversation owns: to be added to the nodes on its path that others own
    by_nodes = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("below").alias("below"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    by_tails = local.where("last").select("conv", F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("below"), F.lit(1).alias("leaf"))
    given = by_nodes.unionByName(by_tails).groupBy("conv").agg(F.min("top").alias("top"), F.sum("below").alias("below"), F.max("leaf").alias("leaf"))
    above = exact.select("conv", "depth", *both).join(given, "conv").where("top is null or depth < top")
    above = above.groupBy(*both).agg(F.sum("below").alias("more"), F.sum("leaf").cast("long").alias("leaves"))
    leaf = given.select("conv", "leaf")
    ends = joined_ids(exact.where("last"))
    whole = nodes.join(above, both, "left").join(leaf, "conv").join(ends, both, "left")

    # parents: the owner itself, but for the first node that a conversation owns
    first = nodes.where("depth = top and depth > 0").select("parent_hi", "parent_lo", "conv", "depth")
    asked = first.unionByName(tops.select("parent_hi", "parent_lo", "conv", "depth"))
    counts = asked.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("asked"))
    found = saved(parents_of(saved(asked, folder, "asked"), nodes.select(*both, "conv").join(counts, both)), folder, "parents")
    found = found.select("conv", "depth", "parent_conv")

    shared = whole.join(found, ["conv", "depth"], "left").select(
        "conv", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv")).alias("parent"), "n_convs", "n_children",
        (F.coalesce("leaves", F.lit(0)) + F.col("leaf")).alias("n_leaves"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    ends = F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA)

    def alone(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(
            "conv", "depth", F.when(F.col("depth") > 0, parent).alias("parent"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"),
        )

    out = shared.unionByName(alone(local.where("not parent_shared or depth = 0"), F.col("conv")))
    out = out.unionByName(alone(tops.where("depth > 0").join(found, ["conv", "depth"]), F.col("parent_conv")))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_digests(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, digest, n_chars) of every turn in its order: by number, none first, then by role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    framed = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"),
        F.unhex(F.md5(framed.cast("binary"))).alias("digest"), F.length(text_).cast("long").alias("n_chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("conv", "place", "digest", "n_chars")


def conversation_trie(turns: DataFrame, folder: str, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", head: tuple[Column, Column, int] | None = None) -> DataFrame:
    """Nodes of the prefix trie of conversations, as in `prefix_nodes`.

    Turns are taken by number (null first), then role and text; a null role or text is empty, and repeated rows are
    turns of their own. Rows without an id belong to no conversation. Two prefixes are the same node if all their roles
    and texts are equal (by 128-bit digests). Columns that are not named are not read; an empty table has no node.

    `head` replaces the first turns of a conversation: (source, count, most), columns of `conv`. The conversation begins
    with the first `count` turns of conversation `source`, or with all it has, followed by its own turns but for its
    first `count`; `most` bounds `count`.
    """
    own = saved(turn_digests(turns, id, turn, role, text), folder, "turns")
    starts = own.where("place = 0").select("conv")
    begun = starts.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    if head is None:
        return prefix_nodes(begun.unionByName(own.withColumn("part", F.lit(1))), folder)
    source, count, most = head
    heads = starts.withColumn("source", source).withColumn("count", count)
    sources = own.where(F.col("place") < most).withColumnRenamed("conv", "source")
    taken = heads.where("count > 0").join(sources, "source").where("place < count").select("conv", F.lit(0).alias("part"), "place", "digest", "n_chars")
    kept = own.withColumn("count", count).where("place >= count").select("conv", F.lit(1).alias("part"), "place", "digest", "n_chars")
    return prefix_nodes(begun.unionByName(taken).unionByName(kept), folder)
