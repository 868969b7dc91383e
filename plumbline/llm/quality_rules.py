"""Quality rules: word statistics, and divergence from a language's usual histograms.

Two histograms of a document, of character classes and of common words, are compared with those of its language over
the whole table, by Jensen-Shannon distance (base 2, so 0 to 1). Short texts vary by chance: a test applies only from
a least length on, and its limit is widened by `slack / n`, the order of the divergence of a sample of n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textscan import LOWER, SPACE, Hasher, code_points, mix, owners, running, text_chunks, windows, words

# Function words of the languages that get a bin of their own.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but are this which or had from at an they were what when"
    " der die das und ist von zu den mit sich des auf für nicht ein eine als auch es dem er wie so aus"
    " le la les et de des du un une en que qui dans pour pas sur au par est plus avec ce se elle"
    " el los las y del se con por su para una lo como más pero sus ya o este no si"
).split()
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: Languages beyond so many, the ones with the fewest characters, are compared with all texts together.
LANGUAGES = 512
#: Steps in which a character class's share is counted.
STEPS = 1000


def _classes() -> np.ndarray:
    """Class of each byte; continuation bytes have none (the last)."""
    out = np.full(256, 9, np.uint8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[SPACE], out[0x20], out[0x0A] = 5, 3, 4
    for k, chars in ((6, b".,;:"), (7, b"!?"), (8, SYMBOLS)):
        out[list(chars)] = k
    out[0x80:0xC0], out[0xC0:0xCA], out[0xCA:] = 12, 10, 11
    return out


CLASS = _classes()
N_CLASSES = 12
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    repeat_percent: int = 30
    class_distance: float = 0.15
    class_min_chars: int = 200
    class_slack: float = 20.0
    word_distance: float = 0.22
    word_min_words: int = 50
    word_slack: float = 10.0


def _common() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words, and the bin of each."""
    texts = sorted({w for w in COMMON_WORDS})
    raw = [w.encode() for w in texts]
    ends = np.cumsum([len(w) for w in raw])
    keys = Hasher(np.frombuffer(b"".join(raw), np.uint8)).of(ends - [len(w) for w in raw], ends)
    order = np.argsort(keys)
    return keys[order], order


_KEYS, _BINS = _common()
N_BINS = N_CLASSES + len(_KEYS) + 1


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each document: counts of character classes, of common words, and of all other words."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.bincount(doc * 13 + CLASS[data], minlength=13 * n).reshape(n, 13)[:, :N_CLASSES]
    lower = LOWER[data]
    starts, ends, doc = words(lower, offsets)
    ends = ends - ((ends - starts > 1) & _TAIL[lower[ends - 1]] if len(ends) else 0)
    keys = Hasher(lower).of(starts, ends)
    at = np.minimum(np.searchsorted(_KEYS, keys), len(_KEYS) - 1)
    kind = np.where(_KEYS[at] == keys, _BINS[at], len(_KEYS))
    width = len(_KEYS) + 1
    common = np.bincount(doc * width + kind, minlength=width * n).reshape(n, width)
    return np.concatenate([chars, common], axis=1)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts to rows of counts; 0 for an empty row on either side."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)]
    out = np.sqrt(np.clip((sides[0] + sides[1]) / 2, 0, 1))
    out[(counts.sum(1) == 0) | (reference.sum(1) == 0)] = 0
    return out


def base_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Word counts, symbols, repeated lines and repeated words of each document."""
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    hasher = Hasher(data)
    points = code_points(data)
    symbols = running(SYMBOL[data])
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": np.bincount(doc, points[ends] - points[starts], n).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _repeated_lines(data, offsets, hasher),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    keys, inside = windows(hasher.of(starts, ends), doc, REPEAT_WINDOW)
    keys = keys[inside] ^ mix(doc[: len(keys)][inside].astype(np.uint64) + np.uint64(1))
    if len(keys):
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        first = np.flatnonzero(inside)[twice]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + REPEAT_WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n).astype(np.int64)
    return out


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    doc = owners(starts, offsets)
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(next_break, offsets[doc + 1])
    solid = running(~SPACE[data])
    use = solid[ends] > solid[starts]
    starts, ends, doc = starts[use], ends[use], doc[use]
    keys = hasher.of(starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    n = len(offsets) - 1
    return (np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)).astype(np.int64)


def _share_buckets(counts: np.ndarray) -> np.ndarray:
    """Of each document and class: the share among its characters in steps of 1 / STEPS."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return (counts * STEPS + total // 2) // total


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 200) -> dict[str | None, np.ndarray]:
    """The usual histograms of each language, and of all texts together under None. Null counts as language "".

    Common words: the sum over all texts. Character classes: the median over all texts of at least `least`
    characters, since a sum would follow a few long odd texts. Medians come from counts of shares in fixed steps,
    so what is gathered is a fixed number of sums for each language.
    """
    steps = STEPS + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).fill_null("").dictionary_encode()
            names, codes = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            common = np.zeros((len(names), N_BINS - N_CLASSES), np.int64)
            shares = np.zeros(len(names) * N_CLASSES * steps, np.int64)
            for low, high, data, offsets in text_chunks(batch.column(0)):
                seen, code = histograms(data, offsets), codes[low:high]
                np.add.at(common, code, seen[:, N_CLASSES:])
                chars = seen[:, :N_CLASSES]
                long = chars.sum(1) >= least
                place = (code[long, None] * N_CLASSES + np.arange(N_CLASSES)) * steps + _share_buckets(chars[long])
                shares += np.bincount(place.ravel(), minlength=len(shares))
            both = np.concatenate([common, shares.reshape(len(names), -1)], axis=1)
            at = np.flatnonzero(both)  # most shares never occur
            owner, place = np.divmod(at, both.shape[1])
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()).take(pa.array(owner)), pa.array(place), pa.array(both.ravel()[at])], names=["lang", "place", "n"])

    parts = docs.select(text, F.col(lang).cast("string")).mapInArrow(scan, "lang string, place long, n long")
    sums = parts.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    weights = sums.groupBy("lang").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "lang").limit(LANGUAGES)
    rows = sums.join(F.broadcast(weights), "lang").select("lang", "place", "n").collect()  # at most LANGUAGES times a fixed size
    whole = sums.groupBy("place").agg(F.sum("n").alias("n")).collect()
    gathered: dict[str | None, np.ndarray] = {}
    for name, place, n in [*rows, *((None, *r) for r in whole)]:
        gathered.setdefault(name, np.zeros(N_BINS - N_CLASSES + N_CLASSES * steps, np.int64))[place] = n
    gathered.setdefault(None, np.zeros(N_BINS - N_CLASSES + N_CLASSES * steps, np.int64))
    return {name: _reference(x) for name, x in gathered.items()}


def _reference(sums: np.ndarray) -> np.ndarray:
    shares = sums[N_BINS - N_CLASSES :].reshape(N_CLASSES, STEPS + 1).cumsum(1)
    median = (2 * shares < shares[:, -1:]).sum(1)
    return np.concatenate([median, sums[: N_BINS - N_CLASSES]]).astype(float)


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row for each row: id, the base statistics, both distances, base_failed and kept.

    Words are runs of non-space characters of the whole text; a null text has none and fails the base rules, as
    an empty one does. A null language is a language of its own. A text below a test's least length passes that test.
    Repeated rows give a row each; columns that are not named are not read; an empty table gives an empty result.
    """
    references = language_references(docs, text, lang, limits.class_min_chars)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).fill_null("").to_pylist()
            for low, high, data, offsets in text_chunks(batch.column(1)):
                out = base_statistics(data, offsets)
                seen = histograms(data, offsets)
                usual = np.stack([references.get(x, references[None]) for x in langs[low:high]])
                chars, common = slice(0, N_CLASSES), slice(N_CLASSES, N_BINS)
                out["class_distance"] = distance(seen[:, chars], usual[:, chars])
                out["word_distance"] = distance(seen[:, common], usual[:, common])
                n_words, n_chars = out["n_words"], seen[:, chars].sum(1)
                failed = (n_words < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * n_words)
                odd = np.zeros(len(failed), bool)
                for n, least, name, limit, slack in (
                    (n_chars, limits.class_min_chars, "class_distance", limits.class_distance, limits.class_slack),
                    (n_words, limits.word_min_words, "word_distance", limits.word_distance, limits.word_slack),
                ):
                    odd |= (n >= least) & (out[name] ** 2 > limit**2 + slack / np.maximum(n, 1))
                out |= {"base_failed": failed, "kept": ~failed & ~odd}
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *(pa.array(x) for x in out.values())], names=[id, *out])

    kind = docs.schema[id].dataType.simpleString()
    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"
    return docs.select(id, text, F.col(lang).cast("string").alias("lang")).mapInArrow(judge, f"`{id}` {kind}, {columns}")
