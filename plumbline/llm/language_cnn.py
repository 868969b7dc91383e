"""Language of a text by a small convolutional network over its bytes, trained in numpy.

A text is cut into windows of a fixed number of bytes. Bytes are embedded, filters of several widths run over a
window, each filter gives its largest value, and a softmax layer over those gives the window's language. A text's
probabilities are the mean over all its windows, each weighted by its letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textscan import text_chunks

#: At most so many texts are learnt from, dealt evenly to the languages, and so many windows of each.
FIT_TEXTS = 4096
FIT_WINDOWS = 6
WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 20
EMBED = 8
STEPS = 1200
BATCH = 128
RATE = 0.004
SEED = 20241
#: Windows that go through the network at once.
BLOCK = 512
#: Stands for what lies beyond the end of a text.
PAD = 256
UNDETERMINED = "und"

_LETTER = np.zeros(PAD + 1, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = 1


class Network:
    """Parameters, and the probabilities they give."""

    def __init__(self, classes: int):
        random = np.random.default_rng(SEED)
        self.values = {"embed": random.normal(0, 0.5, (PAD + 1, EMBED))}
        for w in WIDTHS:
            self.values[f"filter{w}"] = random.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.values[f"bias{w}"] = np.zeros(FILTERS)
        self.values["out"] = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.values["prior"] = np.zeros(classes)
        self.values = {k: v.astype(np.float32) for k, v in self.values.items()}
        self.values["embed"][PAD] = 0

    def patches(self, windows: np.ndarray, width: int) -> np.ndarray:
        """(windows, places, width * EMBED): what each filter sees at each place."""
        embedded = self.values["embed"][windows]
        places = windows.shape[1] - width + 1
        return np.concatenate([embedded[:, k : k + places] for k in range(width)], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        found = [(self.patches(windows, w) @ self.values[f"filter{w}"]).max(1) + self.values[f"bias{w}"] for w in WIDTHS]
        return np.maximum(np.concatenate(found, axis=1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.values["out"] + self.values["prior"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by every parameter."""
        seen, at, tops = {}, {}, []
        rows = np.arange(len(windows))
        for w in WIDTHS:
            seen[w] = self.patches(windows, w)
            values = seen[w] @ self.values[f"filter{w}"]
            at[w] = values.argmax(1)
            tops.append(np.take_along_axis(values, at[w][:, None], 1)[:, 0] + self.values[f"bias{w}"])
        top = np.maximum(np.concatenate(tops, axis=1), 0)
        error = softmax(top @ self.values["out"] + self.values["prior"])
        error[rows, labels] -= 1
        error /= len(windows)
        out = {"out": top.T @ error, "prior": error.sum(0), "embed": np.zeros_like(self.values["embed"])}
        back = (error @ self.values["out"].T) * (top > 0)
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            picked = seen[w][rows[:, None], at[w]]
            out[f"filter{w}"] = np.einsum("bf,bfk->kf", own, picked)
            out[f"bias{w}"] = own.sum(0)
            sent = own[:, :, None] * self.values[f"filter{w}"].T
            for j in range(w):
                np.add.at(out["embed"], windows[rows[:, None], at[w] + j], sent[:, :, j * EMBED : (j + 1) * EMBED])
        out["embed"][PAD] = 0
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, classes: int) -> Network:
    """Adam over shuffled batches, with a fixed seed and number of steps, however few windows there are."""
    network, random = Network(classes), np.random.default_rng(SEED + 1)
    first = {k: np.zeros_like(v) for k, v in network.values.items()}
    second = {k: np.zeros_like(v) for k, v in network.values.items()}
    order = np.zeros(0, np.int64)
    for t in range(1, STEPS + 1) if len(windows) else ():
        if len(order) < BATCH:
            order = np.concatenate([order, random.permutation(len(windows))])
        some, order, rate = order[:BATCH], order[BATCH:], RATE * (1 - t / (STEPS + 1))
        for k, g in network.gradients(windows[some], labels[some]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            network.values[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return network


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, the last of each filled up, and the text of each window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][doc] + place * WINDOW
    index = starts[:, None] + np.arange(WINDOW)
    inside = index < offsets[1:][doc][:, None]
    windows = np.full(index.shape, PAD, np.int16)
    windows[inside] = data[index[inside]]
    return windows, doc


def text_probabilities(network: Network, classes: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages); zeros for texts without a byte."""
    windows, doc = cut(data, offsets)
    total, weight = np.zeros((len(offsets) - 1, classes)), np.zeros(len(offsets) - 1)
    for low in range(0, len(windows), BLOCK):
        some, of = windows[low : low + BLOCK], doc[low : low + BLOCK]
        letters = _LETTER[some].sum(1) + 1e-3
        found = network.probabilities(some) * letters[:, None]
        for k in range(classes):
            total[:, k] += np.bincount(of, found[:, k], len(weight))
        weight += np.bincount(of, letters, len(weight))
    return total / np.maximum(weight, 1e-9)[:, None]


def labelled_windows(docs: DataFrame, id: str, text: str, lang: str, sample: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their language's number, and the languages.

    Of each language the texts whose id's hash is smallest, as many as `sample` over the number of languages (one at
    least; fewer where many rows have one id); of rows with one id and language the least windows. At most FIT_WINDOWS windows of a text, evenly spaced.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("key"), F.col(lang).cast("string").alias("language"), F.col(text).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("language").count().orderBy("language").collect()}
    languages = list(sizes)
    if not languages:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), []
    # Ranks are taken among a few more keys than are wanted, so no task orders all keys of a language.
    wanted = max(1, sample // len(languages))
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, (2 * wanted + 64) / n)) for k, n in sizes.items()], "language string, share double")
    hashed = rows.select("key", "language", F.xxhash64(F.col("key").cast("string")).alias("hash")).join(F.broadcast(shares), "language")
    hashed = hashed.where(F.col("hash") / F.lit(float(1 << 64)) + 0.5 <= F.col("share"))
    order = Window.partitionBy("language").orderBy("hash", "key")
    keys = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    few = F.broadcast(keys.select("key", "language").distinct())  # at most `sample` rows, or one a language

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(2)):
                cuts, doc = cut(data, offsets)
                found = []
                for k in range(high - low):
                    own = cuts[slice(*np.searchsorted(doc, (k, k + 1)))]
                    own = own[_LETTER[own].sum(1) * 4 >= WINDOW]
                    picked = np.unique(np.linspace(0, len(own) - 1, FIT_WINDOWS).astype(int)) if len(own) else []
                    found.append(own[picked].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high].cast(pa.string()), batch.column(1)[low:high], pa.array(found, pa.binary())], names=["key", "language", "windows"])

    cuts = rows.join(few, ["key", "language"]).select("key", "language", "text").mapInArrow(windows, "key string, language string, windows binary")
    got = cuts.groupBy("key", "language").agg(F.min("windows").alias("windows")).orderBy("language", "key").collect()
    place = {x: k for k, x in enumerate(languages)}
    parts = [np.frombuffer(r["windows"], np.int16).reshape(-1, WINDOW) for r in got]
    labels = [place[r["language"]] for r in got]
    return np.concatenate(parts), np.repeat(labels, [len(p) for p in parts]), languages


def predict_language(docs: DataFrame, labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = (), sample: int = FIT_TEXTS) -> DataFrame:
    """One row for each row: id, kept columns, lang_pred (a language of `labelled`) and score, its probability.

    Only the text decides. `labelled` holds id, text and language; rows that must not be learnt from are to be left out
    of it, and those without id or language are. Texts that are null or without a letter, and all texts where no
    language is known, get `und` and score 0. Equal probabilities go to the language that comes first by name. All
    windows of a text count, however long it is. Repeated rows give a row each; columns that are not named are not
    read, and an empty table gives an empty result.
    """
    windows, labels, languages = labelled_windows(labelled, id, text, lang, sample)
    network = train(windows, labels, len(languages)) if languages else None
    shared = docs.sparkSession.sparkContext.broadcast((network, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, languages = shared.value
        names = np.array([*languages, UNDETERMINED], object)
        for batch in batches:
            lettered = np.asarray(batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for low, high, data, offsets in text_chunks(batch.column(batch.num_columns - 2)):
                best, score = np.full(high - low, len(languages)), np.zeros(high - low)
                if languages:
                    found = text_probabilities(network, len(languages), data, offsets)
                    known = lettered[low:high]
                    best[known] = found[known].argmax(1)
                    score[known] = np.minimum(found[known].max(1), 1)
                kept = [batch.column(k)[low:high] for k in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score)], names=[id, *keep, "lang_pred", "score"])

    sent = [F.col(f"`{c}`") for c in (id, *keep)]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *keep))
    letter = F.col(text).rlike(r"\p{L}")
    return docs.select(*sent, F.col(text).alias("__text"), letter.alias("__letter")).mapInArrow(run, f"{fields}, lang_pred string, score double")
