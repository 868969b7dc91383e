"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: its words, the shapes of its words (classes of first and last characters), and
terms for repeated words and repeated runs of words. Weights are log counts times inverse document frequency, and a
truncated singular value decomposition of a bounded labelled sample gives the latent space. The sample's vectors
are sent to every worker (at most SAMPLE x RANK floats); each text is compared with all of them by blocked
cosine products, and its nearest NEIGHBOURS (in a small sample its square root) vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textscan import LOWER, Hasher, mix, text_chunks, windows, words

WORD_TERMS = 1536
SHAPE_TERMS = 512
TERMS = WORD_TERMS + SHAPE_TERMS
#: Bounds of the fit: labelled texts, bytes read of them in all, size of the space.
SAMPLE = 4096
RANK = 48
NEIGHBOURS = 31
BLOCK = 512

_KIND = np.full(256, 3, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[0x80:] = 0, 1, 2, 0


@dataclass(frozen=True)
class Space:
    """A fitted space with its labelled vectors; all of it is a few MB."""

    weights: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # sample x RANK, unit length
    labels: np.ndarray
    prior: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours; the prior where nothing is similar."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, int(np.ceil(np.sqrt(len(self.labels)))))
        for low in range(0, len(counts), BLOCK):
            rows = self.project(counts[low : low + BLOCK])
            close = rows @ self.vectors.T
            near = np.argpartition(close, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(close, near, 1), 0).astype(np.float64)
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            here = total > 1e-9
            out[low : low + len(rows)][here] = np.clip(vote[here] / total[here], 0, 1)
        return out

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(counts).astype(np.float32) * self.weights) @ self.axes)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, a row for each text."""
    n = len(offsets) - 1
    lower = LOWER[data]
    starts, ends, doc = words(lower, offsets)
    if not len(starts):
        return np.zeros((n, TERMS), np.float32)
    keys = Hasher(lower).of(starts, ends)
    terms = [(doc, keys % np.uint64(WORD_TERMS))]
    last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
    shape = _KIND[data[starts]] + _KIND[data[np.minimum(starts + 1, ends - 1)]] * np.uint64(4)
    shape = shape + np.where(_KIND[last] == 3, last.astype(np.uint64) + np.uint64(256), _KIND[last]) * np.uint64(16)
    shape = shape + (before == last).astype(np.uint64) * np.uint64(1 << 20)
    terms.append((doc, WORD_TERMS + mix(shape) % np.uint64(SHAPE_TERMS - 16)))
    same = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    terms.append((doc[1:][same], np.full(int(same.sum()), TERMS - 16, np.uint64)))
    runs, inside = windows(keys, doc, 4)
    if inside.any():
        at = doc[: len(runs)][inside]
        own = runs[inside] ^ mix(at.astype(np.uint64))
        order = np.argsort(own)
        twice = order[1:][own[order][1:] == own[order][:-1]]
        # A tenth of repeated runs more, one term more: short and long texts look alike.
        share = np.bincount(at[twice], minlength=n) / np.maximum(np.bincount(at, minlength=n), 1)
        for k in range(1, 11):
            some = np.flatnonzero(share * 10 >= k)
            terms.append((np.repeat(some, 8), np.full(8 * len(some), TERMS - 16 + k, np.uint64)))
    place = np.concatenate([d * TERMS + t.astype(np.int64) for d, t in terms])
    return np.bincount(place, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


@dataclass(frozen=True)
class Sample:
    """Term counts of the labelled texts, only those that are not 0, one text after the other."""

    labels: np.ndarray
    sizes: np.ndarray  # terms of each text
    places: np.ndarray
    values: np.ndarray

    def rows(self, weights: np.ndarray) -> np.ndarray:
        """Weighted log counts, a row of unit length for each text, without a second array of that size."""
        out = np.zeros((len(self.labels), TERMS), np.float32)
        out[np.repeat(np.arange(len(out)), self.sizes), self.places] = np.log1p(self.values) * weights[self.places]
        for low in range(0, len(out), BLOCK):
            out[low : low + BLOCK] = unit(out[low : low + BLOCK])
        return out


def _gram(rows: np.ndarray) -> np.ndarray:
    return rows.T @ rows


def fit_space(sample: Sample, rank: int = RANK) -> Space:
    """Decomposition of the sample's weighted term matrix by its Gram matrix over terms.

    This runs in the driver. The rows are made twice, so that they are not there beside the decomposition.
    """
    n = len(sample.labels)
    weights = np.log((1 + n) / (1 + np.bincount(sample.places, minlength=TERMS))).astype(np.float32) + 1
    _, axes = np.linalg.eigh(_gram(sample.rows(weights)))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :rank]).astype(np.float32)
    prior = (float(sample.labels.sum()) + 1) / (n + 2)
    return Space(weights, axes, unit(sample.rows(weights) @ axes).astype(np.float32), sample.labels.astype(np.float64), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE) -> Sample:
    """Term counts and labels of at most `sample` labelled texts, those whose id's hash is smallest.

    Half of the sample goes to each label as far as there are rows. Labels whose id or value is null, or whose id
    occurs twice with different values, are left out.
    """
    one = labels.select(F.col(id).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    one = one.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    order = F.xxhash64("key"), F.col("key")
    halves = [one.where(F.col("label") == k).orderBy(*order).limit(sample // 2).select("key", "label") for k in (0, 1)]
    few = F.broadcast(halves[0].unionByName(halves[1]))  # at most `sample` rows of two numbers
    texts = docs.select(F.col(id).alias("key"), F.col(text).alias("text")).join(few, "key").select("key", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(2)):
                rows = term_counts(data, offsets)
                at, place = np.nonzero(rows)
                cuts = np.searchsorted(at, np.arange(len(rows) + 1))
                places = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place, pa.int32()))
                values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rows[at, place], pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high].cast(pa.string()), batch.column(1)[low:high], places, values], names=["key", "label", "places", "values"])

    schema = "key string, label int, places array<int>, values array<float>"
    table = texts.mapInArrow(count, schema).dropDuplicates(["key"]).orderBy("key").drop("key").toArrow()
    sizes = pc.list_value_length(table["places"]).to_numpy()
    places, values = (pc.list_flatten(table[c]).to_numpy() for c in ("places", "values"))
    return Sample(table["label"].to_numpy().astype(np.int64), sizes, places, values)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", keep: tuple[str, ...] = (), sample: int = SAMPLE, score: str = "score") -> DataFrame:
    """One row for each row: id, kept columns (the text may be one), and score, the weighted share of label 1 among its neighbours.

    Only the text is an input of a score. `labels` holds id and label; rows that must not be learnt from are to be
    left out of it. Null and empty texts, and all texts where there are no labels, get the prior share of label 1
    in the sample. Repeated rows give a row each with equal scores; columns that are not named are not read; an
    empty table gives an empty result.
    """
    space = fit_space(labelled_sample(docs, labels, id, text, label, sample))
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                found = shared.value.scores(term_counts(data, offsets))
                kept = [batch.column(at)[low:high] for at in places]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[id, *keep, score])

    sent = [id, *(c for c in keep if c not in (id, text)), text]
    places = [sent.index(c) for c in (id, *keep)]
    names = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *keep))
    return docs.select(*sent).mapInArrow(run, f"{names}, `{score}` double")
