"""Exact n-gram Jaccard join: partition signatures bring texts together, signature trees find the links.

Sets whose similarity reaches the threshold differ in at most d elements, so of d + 1 parts of the hash space they
agree on one. Every set gives the hash of each of its parts, for its own size class and the next one; equal hashes
make candidates, and no similar pair is missed. Candidates first meet as small bitmaps in signature trees; what the
bitmaps cannot tell apart makes clusters. A cluster is cut into blocks of bounded size, and each block's sets are joined
by a signature tree. In clusters of several blocks that stay apart, sets of different components that share a
signature are then joined around the largest of these components.
Links are a spanning forest: within a group of copies no more links are made than connect it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocked_bloom import build_bloom
from plumbline.llm.components import components
from plumbline.llm.shared import saved
from plumbline.llm.signature_tree import possible_links, spanning_links
from plumbline.llm.textscan import LOWER, Hasher, mix, text_chunks, windows, words

#: Shingles in one block, at most about twice as many.
BLOCK_SHINGLES = 1 << 19
#: A block of bitmaps stands for so many times as many.
SMALLER = 16
SEEDS = 4


@lru_cache(maxsize=4)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest size, number of parts, and empty parts allowed, of each class, up to 2^40 shingles.

    A set of class c is at most as large as the largest of class c + 1 that can be similar. Sets that meet at class
    c differ in at most d elements and have d + 1 + e parts, so they agree on e + 1. A set with more than e empty
    parts is dealt again with the next seed; both sets of a pair that agrees on empty parts only are such sets.
    """
    tops, parts, empty = [1], [], []
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, 100 * tops[-1] // percent, 21 * tops[-1] // 20))
    for c, top in enumerate(tops):
        differ = 2 * top * (100 - percent) // (100 + percent)
        least = 1 if c < 2 else tops[c - 2] + 1
        spare = 0  # the least that is enough: what is needed grows with the number of parts
        while spare <= differ and (need := ceil(_likely_empty(differ + 1 + spare, least))) > spare:
            spare = need
        spare = spare if spare <= differ else 0
        parts.append(differ + 1 + spare)
        empty.append(spare)
    return np.array(tops), np.array(parts), np.array(empty)


def _likely_empty(k: int, n: int) -> float:
    """Two deviations above the mean of how many of k parts n elements leave empty; 0 where hardly any."""
    mean = k * (1 - 1 / k) ** n if k > 1 else 0
    return mean + 2 * mean**0.5 if mean > 0.02 else 0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each begins (one more at the end)."""
    lower = LOWER[data]
    starts, ends, doc = words(lower, offsets)
    n = len(offsets) - 1
    keys = Hasher(lower).of(starts, ends)
    found, inside = windows(keys, doc, size)
    at = np.searchsorted(doc, np.arange(n + 1))
    out, cuts = [], [0]
    for k in range(n):
        low, high = int(at[k]), int(at[k + 1])
        if high - low >= size:
            own = np.unique(found[low : high - size + 1])
        elif high > low:  # the whole sequence, told apart from shingles by its length
            own = keys[high - 1 : high]
            for w in range(high - 2, low - 1, -1):
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + keys[w])
            own = mix(own + np.uint64(high - low))
        else:
            own = keys[:0]
        out.append(own)
        cuts.append(cuts[-1] + len(own))
    return np.concatenate(out) if out else keys[:0], np.array(cuts)


def digests(shingles: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles ^ np.uint64(salt * 0x9E3779B1)), out=total[1:])
        out.append(mix(total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(shingles: np.ndarray, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set, one after the other, and where each set's begin."""
    tops, parts, empty = size_classes(percent)
    sizes = np.diff(cuts)
    own = np.searchsorted(tops, sizes)
    out, owner = [], []
    for step in (0, 1):
        rows = np.flatnonzero(sizes > 0)
        for seed in range(SEEDS):
            level = own[rows] + step
            k = parts[level]
            base = np.concatenate([[0], np.cumsum(k)])
            length = sizes[rows]
            which = np.repeat(np.arange(len(rows)), length)
            index = np.arange(len(which)) + np.repeat(cuts[rows] - (np.cumsum(length) - length), length)
            element = mix(shingles[index] ^ np.uint64(0xA5A5 + 0x10001 * seed))
            place = base[which] + ((element >> np.uint64(20)) % k[which].astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(base[-1]), np.uint64)
            np.add.at(total, place, mix(element))
            count = np.bincount(place, minlength=len(total))
            of = np.repeat(np.arange(len(rows)), k)
            part = np.arange(len(total)) - base[of]
            name = (level[of].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) * np.uint64(SEEDS) + np.uint64(seed)
            give = np.ones(len(total), bool) if seed == SEEDS - 1 else count > 0
            out.append(mix(total ^ mix(name))[give])
            owner.append(rows[of[give]])
            rows = rows[np.bincount(of[count == 0], minlength=len(rows)) > empty[level]]
            if not len(rows):
                break
    found, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))


def _described(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """id, n, d1 and d2 of each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                shingles, cuts = shingle_sets(data, offsets, size)
                d1, d2 = digests(shingles, cuts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(np.diff(cuts)), pa.array(d1), pa.array(d2)], names=["id", "n", "d1", "d2"])

    return docs.select(id, text).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long")


def _shared(docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """(signature, head): every signature that different sets have, and the least d1 of those.

    Each task sends, half a million signatures at a time, only the least and the greatest d1 of each signature, so one
    that a third of all sets share is a few rows a task. They are dealt out and sorted once; runs of equal ones are
    read as a stream, whatever their length.
    """

    def combine(sent: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        last = np.append(first[1:], True)
        ends = first | (last & (values != values[first][np.cumsum(first) - 1]))
        return pa.RecordBatch.from_arrays([pa.array(keys[ends]), pa.array(values[ends])], names=["key", "value"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, total = [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                shingles, cuts = shingle_sets(data, offsets, size)
                d1, _ = digests(shingles, cuts)
                found, at = signatures(shingles, cuts, percent)
                sent.append((found.view(np.int64), np.repeat(d1, np.diff(at))))
                total += len(found)
                if total > 1 << 19:
                    yield combine(sent)
                    sent, total = [], 0
        if total:
            yield combine(sent)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None  # of the run that may go on
        given = False  # whether that run has been handed on
        for batch in batches:
            keys, values = (batch.column(k).to_numpy() for k in range(2))
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            heads = values[first]
            goes_on = keys[0] == key
            if goes_on:
                heads[0] = head
            several = np.logical_or.reduceat(values != np.repeat(heads, np.diff(np.append(first, len(keys)))), first)
            use = several.copy()
            if goes_on:
                use[0] &= not given
            given = bool(several[-1]) or (goes_on and len(first) == 1 and given)
            key, head = keys[-1], heads[-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first][use]), pa.array(heads[use])], names=["signature", "head"])

    rows = docs.where(F.col(id).isNotNull()).select(text).mapInArrow(sign, "key long, value long")
    return rows.repartition("key").sortWithinPartitions("key", "value").mapInArrow(runs, "signature long, head long")


def bitmap(shingles: np.ndarray) -> bytes:
    """The set with about a bit for each element; sets of one size have one width."""
    width = max(64, 1 << int(len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[shingles & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _possible(docs: DataFrame, classes: DataFrame, folder: str, id: str, text: str, size: int, percent: int) -> DataFrame:
    """(u, v): d1 of sets that might be similar, as many pairs as connect all that might be.

    Sets with a signature in common meet at the least of all that have it. There they are joined as a signature tree
    of small bitmaps, a bit for each element, which bounds what they can have in common. Texts that share no more than a
    passage are told apart here, and their sets go nowhere.
    """
    reps = classes.select(F.col("rep").alias("id"), "d1", "d2", "n")
    heads = saved(_shared(docs, id, text, size, percent), folder, "heads")
    key = ["id", "d1", "d2"]
    signed = _signed(docs, reps, id, text, size, percent, heads.select("signature")).join(reps, key)
    signed = saved(signed.select("d1", "n", "bits", "signatures"), folder, "signed")
    met = signed.select("d1", F.explode("signatures").alias("signature")).join(heads, "signature").select("head", "d1").distinct()
    met = saved(met.join(signed.drop("signatures"), "d1"), folder, "met")
    most = SMALLER * BLOCK_SHINGLES
    cuts = met.groupBy("head").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    placed = met.join(cuts.where("blocks > 1"), "head", "left").withColumn("block", F.pmod(F.xxhash64("d1"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.concat_ws(":", "head", F.least("block", k), F.greatest("block", k)))
    groups = F.when(F.col("blocks").isNull(), F.array(F.col("head").cast("string"))).otherwise(pairs)
    rows = placed.select("d1", "n", "bits", F.explode(groups).alias("group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("group", sort=False):
            ids = g["d1"].to_numpy()
            out += [(ids[i], ids[j]) for i, j in possible_links(list(g["bits"]), g["n"].to_numpy(), percent)]
        return pd.DataFrame(out, columns=["u", "v"])

    total = met.agg(F.sum("n")).first()[0] or 0
    parts = max(1, 2 * total // most, met.sparkSession.sparkContext.defaultParallelism)
    return rows.groupBy(F.pmod(F.xxhash64("group"), F.lit(parts))).applyInPandas(run, "u long, v long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """id, d1, d2 and packed set of the rows whose id may be wanted."""
    kind = docs.schema[id].dataType.simpleString()
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(wanted.select(F.xxhash64("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.value.might_hold(batch.column(2).to_numpy())))
            for low, high, data, offsets in text_chunks(batch.column(1)):
                shingles, cuts = shingle_sets(data, offsets, size)
                d1, d2 = digests(shingles, cuts)
                sets = [shingles[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(d1), pa.array(d2), pa.array(sets, pa.binary())], names=["id", "d1", "d2", "set"])

    rows = docs.where(F.col(id).isNotNull()).select(id, text, F.xxhash64(id))
    return rows.mapInArrow(run, f"id {kind}, d1 long, d2 long, set binary")


def _signed(docs: DataFrame, wanted: DataFrame, id: str, text: str, size: int, percent: int, among: DataFrame | None = None) -> DataFrame:
    """id, d1, d2, bitmap and signatures of the rows whose id may be wanted; only signatures that may be `among` those."""
    kind = docs.schema[id].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    bloom = context.broadcast(build_bloom(wanted.select(F.xxhash64("id"))))
    some = context.broadcast(build_bloom(among) if among is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.value.might_hold(batch.column(2).to_numpy())))
            for low, high, data, offsets in text_chunks(batch.column(1)):
                shingles, cuts = shingle_sets(data, offsets, size)
                d1, d2 = digests(shingles, cuts)
                found, at = signatures(shingles, cuts, percent)
                if some.value is not None and len(found):
                    use = some.value.might_hold(found.view(np.int64))
                    found, at = found[use], np.concatenate([[0], np.cumsum(use)])[at]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))
                bits = pa.array([bitmap(shingles[a:b]) if j > i else b"" for a, b, i, j in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)], pa.binary())
                out = [batch.column(0)[low:high], pa.array(d1), pa.array(d2), bits, lists]
                yield pa.RecordBatch.from_arrays(out, names=["id", "d1", "d2", "bits", "signatures"])

    rows = docs.where(F.col(id).isNotNull()).select(id, text, F.xxhash64(id))
    return rows.mapInArrow(run, f"id {kind}, d1 long, d2 long, bits binary, signatures array<long>").where(F.size("signatures") > 0)


def _met(docs: DataFrame, open_: DataFrame, folder: str, id: str, text: str, size: int, percent: int) -> DataFrame:
    """id, d1, d2, n, rank and group of the sets to compare: all pairs of different components with a common signature.

    open_: id, d1, d2, n and root of sets that are not all connected. Components are ranked by size. A signature's
    sets go to the greatest of its components, so a large family and a few strangers are one star, in which each set
    of the family stands once for each block of strangers. Both sides are cut into blocks of bounded size.
    """
    roots = open_.groupBy("root").agg(F.sum("n").alias("weight")).orderBy("weight", "root")
    ranks = saved(roots.select("root", F.monotonically_increasing_id().alias("rank")), folder, "ranks")
    ranked = saved(open_.join(ranks, "root").select("id", "d1", "d2", "n", "rank"), folder, "ranked")
    key = ["id", "d1", "d2"]
    every = _signed(docs, ranked, id, text, size, percent).join(ranked, key).select("rank", F.explode("signatures").alias("signature"))
    heads = every.groupBy("signature").agg(F.min("rank").alias("least"), F.max("rank").alias("head")).where("least <> head")
    heads = saved(heads.select("signature", "head"), folder, "met-heads")
    again = _signed(docs, ranked, id, text, size, percent, heads.select("signature")).join(ranked, key)
    again = again.select(*key, "n", "rank", F.explode("signatures").alias("signature")).join(heads, "signature")
    others = saved(again.where("rank <> head").select("head", *key, "n", "rank").distinct(), folder, "others")
    own = ranked.join(others.select(F.col("head").alias("rank")).distinct(), "rank").select(F.col("rank").alias("head"), *key, "n", "rank")
    count = lambda n: F.ceil(F.sum(n) / BLOCK_SHINGLES).cast("int")
    cuts = own.groupBy("head").agg(count("n").alias("mine")).join(others.groupBy("head").agg(count("n").alias("theirs")), "head")
    deal = lambda blocks: F.pmod(F.xxhash64("d1", "d2"), F.col(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    name = lambda a, b: F.concat_ws(":", "head", a, b)
    own = own.join(cuts, "head").withColumn("block", deal("mine")).withColumn("other", F.explode(upto("theirs")))
    own = own.select(*key, "n", "rank", name("block", "other").alias("group"))
    others = others.join(cuts, "head").withColumn("block", deal("theirs"))
    across = F.transform(upto("mine"), lambda k: name(k, F.col("block")))
    beside = F.transform(
        F.filter(upto("theirs"), lambda k: k != F.col("block")),
        lambda k: F.concat_ws(":", "head", F.lit("other"), F.least("block", k), F.greatest("block", k)),
    )
    others = others.select(*key, "n", "rank", F.explode(F.concat(across, beside)).alias("group"))
    return saved(own.unionByName(others), folder, "met-again")


def _tasks(rows: DataFrame) -> int:
    """Parts into which rows, one for each copy of a set of n shingles, are dealt."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    return max(1, 2 * total // BLOCK_SHINGLES, rows.sparkSession.sparkContext.defaultParallelism)


def _tree_join(rows: DataFrame, blocks: int, percent: int, kind: str) -> DataFrame:
    """Links (u, v) within each group of (id, d1, d2, label, set, group); many groups share a task's memory in turn."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("group", sort=False):
            g = g.drop_duplicates(["id", "d1", "d2"])
            ids = g["id"].to_numpy()
            links = spanning_links([np.frombuffer(s, np.uint64) for s in g["set"]], g["label"].to_numpy(), percent)
            out += [(ids[i], ids[j]) for i, j in links]
        return pd.DataFrame(out, columns=["u", "v"])

    return rows.groupBy(F.pmod(F.xxhash64("group"), F.lit(blocks))).applyInPandas(run, f"u {kind}, v {kind}")


def jaccard_components(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row: id, n_shingles (distinct), and component_id, the least id it is linked with.

    Words are runs of non-space characters with A-Z in lower case. A text of fewer than `size` words is one shingle;
    null and empty texts have none and are linked with nothing; a row whose id is null is not linked and has a null
    component. Rows with equal ids belong together. Columns that are not named are not read, so names cannot clash;
    an empty table gives an empty result. Intermediate tables go to `folder`, which all executors share.
    """
    kind = docs.schema[id].dataType.simpleString()
    described = saved(_described(docs, id, text, size), folder, "described")
    base = described.where("id is not null and n > 0")
    classes = base.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))

    same = _same_id(base, classes, folder)

    clusters = components(_possible(docs, classes, folder, id, text, size, percent), folder, "clusters")

    # Blocks: the sets of a cluster dealt by hash, as many blocks as its shingles need.
    members = classes.join(clusters, F.col("d1") == F.col("node")).select(F.col("rep").alias("id"), "d1", "d2", "n", F.col("root").alias("cluster"))
    members = saved(members, folder, "members")
    totals = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("d1").alias("first"), F.max("d1").alias("last"))
    totals = totals.select("cluster", "first", "last", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    size_of = totals.agg(F.sum("blocks"), F.max("blocks"), F.count(F.lit(1))).first()
    if not size_of[2]:
        return _labelled(described, classes, components(same, folder, "components") if same is not None else None, id)
    placed = members.join(totals, "cluster").withColumn("block", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
    placed = saved(placed, folder, "placed")
    sets = _sets(docs, placed, id, text, size)

    # Two sets of a cluster stand in all its blocks and bridge them.
    hub = F.col("d1").isin(F.col("first"), F.col("last")) & (F.col("blocks") > 1)
    inside = placed.withColumn("block", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    inside = inside.withColumn("group", F.concat_ws(":", "cluster", "block"))
    rows = inside.join(sets, ["id", "d1", "d2"]).select("id", "d1", "d2", F.xxhash64("id", "d1", "d2").alias("label"), "set", "group")
    links = saved(_tree_join(rows, _tasks(inside), percent, kind), folder, "links")
    links = links.unionByName(same) if same is not None else links

    if size_of[1] > 1:  # sets with a common signature, where a cluster is not yet one component
        found = components(links, folder, "inside")
        open_ = placed.where("blocks > 1").join(found, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
        split = open_.groupBy("cluster").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("cluster")
        open_ = saved(open_.join(split, "cluster").select("id", "d1", "d2", "n", "root"), folder, "open")
        if not open_.isEmpty():
            met = _met(docs, open_, folder, id, text, size, percent)
            pairs = met.join(sets, ["id", "d1", "d2"]).select("id", "d1", "d2", F.col("rank").alias("label"), "set", "group")
            links = links.unionByName(saved(_tree_join(pairs, _tasks(met), percent, kind), folder, "cross-links"))
    return _labelled(described, classes, components(links, folder, "components"), id)


def _same_id(base: DataFrame, classes: DataFrame, folder: str) -> DataFrame | None:
    """Links between the classes of each id that has several texts; None if no id has."""
    text = F.struct("d1", "d2", "n")
    several = base.groupBy("id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("id")
    several = saved(several, folder, "several")
    if several.isEmpty():
        return None
    held = base.join(several, "id").distinct().join(classes, ["d1", "d2", "n"]).select("id", "rep")
    first = held.groupBy("id").agg(F.min("rep").alias("u"))
    return saved(held.join(first, "id").select("u", F.col("rep").alias("v")).where("u <> v").distinct(), folder, "same")


def _labelled(described: DataFrame, classes: DataFrame, found: DataFrame | None, id: str) -> DataFrame:
    if found is not None:
        classes = classes.join(found, F.col("rep") == F.col("node"), "left").withColumn("rep", F.coalesce("root", "rep"))
    keys = ["d1", "d2", "n"]
    # Empty sets, and rows without an id, have no class; their own key keeps them apart.
    linked = described.where("id is not null and n > 0").select("id", *keys).join(classes.select(*keys, "rep"), keys)
    alone = described.where("id is null or n = 0")
    rows = linked.select("id", "n", "rep").unionByName(alone.select("id", "n", F.col("id").alias("rep")))
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
