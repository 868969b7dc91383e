"""Benchmark decontamination on templates.

Words become tokens without (Latin) case and outer punctuation; numbers, units after a number and names become typed
placeholders that remember their value. Windows of WINDOW tokens of both sides are hash-joined. Hits of one document
and item on one diagonal are an occurrence; it counts if its slots are consistent, that is, every value of the item
stands for one value of the document. So a question with other names and numbers is found, and a chance mixture of
placeholders is not. Windows with too few literal words are compared by their values and count wherever they are
found. Items of fewer than three words, or with letters of scripts without spaces, also have windows of finer tokens,
in which each such letter stands for itself. A document is contaminated by an item of whose windows it holds at least
SHARE: of the templates, of all windows, or of the finer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocked_bloom import build_bloom
from plumbline.llm.quality_rules import COMMON_WORDS
from plumbline.llm.textscan import SPACE, Hasher, lower_latin, mix, owners, running, text_chunks, windows, words

WINDOW = 6
MIN_LITERALS = 3
SHARE = 0.3
#: What a window is compared by: templates, values of all its words, or letters.
TEMPLATE, VALUES, LETTERS = range(3)

# Words that are numbers, and units that may follow a number.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen twice"
).split()
UNITS = (
    "m km cm mm mile miles yard yards foot feet ft inch inches meter meters metre metres kilometer kilometers kilometre kilometres"
    " g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons l ml liter liters litre litres gallon gallons"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit kelvin mph kmh volt volts watt watts joule joules"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_NUMBER, _UNIT, _NAME = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _word_keys(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(Hasher(np.frombuffer(b"".join(raw), np.uint8)).of(ends - [len(r) for r in raw], ends))


_NUMBER_KEYS, _UNIT_KEYS, _COMMON_KEYS = _word_keys(NUMBER_WORDS), _word_keys(UNITS), _word_keys(sorted(set(COMMON_WORDS)))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, slot values (0 for literal words), documents and keys of the values of the tokens."""
    starts, ends, doc = words(data, offsets)
    n = len(data)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return none, none.view(np.int64), np.zeros(0, np.int64), none
    solid = ~_PUNCTUATION[data]
    place = np.arange(n)
    first = np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1][starts]
    last = np.maximum.accumulate(np.where(solid, place, -1))[ends - 1] + 1
    lines = running(data == 0x0A)
    opens = np.ones(len(starts), bool)  # begins a sentence or a line
    opens[1:] = (doc[1:] != doc[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    use = first < np.minimum(last, ends)
    # A sentence that begins with bare punctuation begins with the next word.
    carried = np.maximum.accumulate(np.where(use, np.arange(len(use)), -1))
    before = np.concatenate([[-1], carried[:-1]])
    opened = np.cumsum(opens)
    first, last, doc, before, opened_at = first[use], last[use], doc[use], before[use], opened[use]
    opens = np.where(before >= 0, opened_at > opened[np.maximum(before, 0)], True)
    if not len(first):
        return none, none.view(np.int64), np.zeros(0, np.int64), none
    lower = lower_latin(data)
    keys = Hasher(lower).of(first, last)
    number = _DIGIT[data[first]] | _among(keys, _NUMBER_KEYS)
    unit = np.zeros(len(keys), bool)
    unit[1:] = number[:-1] & ~number[1:] & (doc[1:] == doc[:-1]) & _among(keys[1:], _UNIT_KEYS)
    second = data[np.minimum(first + 1, n - 1)]
    capital = _UPPER[data[first]] & (last - first > 1) & ~_UPPER[second] & ~number & ~unit
    # What is a name depends on the word and the one before only: a copied passage has the same windows anywhere.
    name = capital & ~opens & ~_among(keys, _COMMON_KEYS)
    values = np.where(number | unit | name, keys | np.uint64(1), np.uint64(0)).view(np.int64)
    return np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], keys), values, doc, keys


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point at each first byte of one (0 elsewhere), and how many bytes it has."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[k : k + len(data)] for k in range(4))
    size = np.select([a < 0x80, a < 0xC0, a < 0xE0, a < 0xF0], [1, 0, 2, 3], 4)
    b, c, d = b & 63, c & 63, d & 63
    two, three, four = (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d
    return np.select([size == 1, size == 2, size == 3, size == 4], [a, two, three, four], 0), size


def _unspaced(points: np.ndarray) -> np.ndarray:
    """Letters of scripts without spaces: Thai to Tibetan, Burmese, Khmer, Chinese, Japanese."""
    out = np.zeros(len(points), bool)
    for low, high in ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)):
        out |= (points >= low) & (points <= high)
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and documents of finer tokens, and which are letters of scripts without spaces; other words stay whole."""
    none = np.zeros(0, np.uint64)
    if not len(data):
        return none, np.zeros(0, np.int64), np.zeros(0, bool)
    points, size = _points(data)
    # Wide punctuation parts words as blanks do.
    wide = ((points >= 0x2010) & (points <= 0x2027)) | ((points >= 0x3000) & (points <= 0x3020) & (points != 0x3005) & (points != 0x3006) & (points != 0x3007))
    wide |= ((points >= 0xFF01) & (points <= 0xFF0F)) | ((points >= 0xFF1A) & (points <= 0xFF20)) | (points == 0x30FB) | ((points >= 0xFF5B) & (points <= 0xFF65))
    first = np.maximum.accumulate(np.where(size > 0, np.arange(len(data)), 0))
    apart, single = wide[first], _unspaced(points)[first]
    blank = SPACE[data] | apart
    doc_of = owners(np.arange(len(data)), offsets)
    new = np.ones(len(data), bool)
    new[1:] = (blank[1:] != blank[:-1]) | (single[1:] != single[:-1]) | (doc_of[1:] != doc_of[:-1])
    new |= single & (size > 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    use = ~blank[starts]
    starts, ends = starts[use], ends[use]
    # Outer (Latin) punctuation goes, as in templates.
    place, solid = np.arange(len(data)), ~_PUNCTUATION[data]
    inner = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1][starts]
    outer = np.maximum.accumulate(np.where(solid, place, -1))[ends - 1] + 1 if len(ends) else ends
    use = inner < np.minimum(outer, ends)
    starts, ends = inner[use], outer[use]
    if not len(starts):
        return none, np.zeros(0, np.int64), np.zeros(0, bool)
    return Hasher(lower_latin(data)).of(starts, ends), doc_of[starts], single[starts]


def _windows(keys: np.ndarray, values: np.ndarray, doc: np.ndarray, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of windows, which are whole, and which hold too few literal words and are hashed by their values."""
    found, inside = windows(keys, doc, size)
    exact, _ = windows(raw, doc, size)
    literal = running(values == 0)
    few = literal[size:] - literal[: len(found)] < min(MIN_LITERALS, size)
    return np.where(few, mix(exact ^ np.uint64(0x56A1)), found) ^ np.uint64(size), inside, few


def _fine_windows(keys: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of finer tokens, and which are whole."""
    found, inside = windows(keys, doc, size)
    return mix(found ^ np.uint64(0x1E77)) ^ np.uint64(size), inside


def _rows(owner: pa.Array, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, found: np.ndarray, values: np.ndarray, size: int, mode: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Slots are given for templates only: what is compared by values has none."""
    slots = np.where(mode == TEMPLATE, size, 0)
    cuts = np.concatenate([[0], np.cumsum(slots)])
    own = (at[mode == TEMPLATE][:, None] + np.arange(size)).ravel()
    slots = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[own], pa.int64()))
    position = pa.array(at - begin[doc[at]])
    return pa.RecordBatch.from_arrays([owner.take(pa.array(doc[at])), position, pa.array(found[at].view(np.int64)), slots, pa.array(mode, pa.int32()), pa.array(np.full(len(at), size), pa.int32())], names=names)


def _begins(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n))


def benchmark_windows(benchmark: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item, position, hash, slots, mode and width of each window. Items of fewer tokens are one window."""
    kind = benchmark.schema[id].dataType.simpleString()
    names = ["item", "item_at", "hash", "item_slots", "item_mode", "item_width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                owner = batch.column(0)[low:high]
                keys, values, doc, raw = template(data, offsets)
                sizes = np.bincount(doc, minlength=high - low)
                begin = _begins(doc, high - low)
                for width in (size, *(w for w in np.unique(sizes).tolist() if 3 <= w < size)):
                    found, use, few = _windows(keys, values, doc, raw, width)
                    at = np.flatnonzero(use)
                    at = at if width == size else at[sizes[doc[at]] == width]
                    yield _rows(owner, at, doc, begin, found, values, width, np.where(few[at], VALUES, TEMPLATE), names)
                keys, doc, single = letters(data, offsets)
                fine = (sizes < 3) | (np.bincount(doc, single, high - low) > 0)
                sizes = np.bincount(doc, minlength=high - low)
                begin = _begins(doc, high - low)
                for width in (2 * size, *(w for w in np.unique(sizes[fine]).tolist() if 1 <= w < 2 * size)):
                    found, use = _fine_windows(keys, doc, width)
                    at = np.flatnonzero(use)
                    at = at[fine[doc[at]]]
                    at = at if width == 2 * size else at[sizes[doc[at]] == width]
                    yield _rows(owner, at, doc, begin, found, np.zeros(0, np.int64), width, np.full(len(at), LETTERS), names)

    return benchmark.select(id, text).mapInArrow(run, f"item {kind}, item_at long, hash long, item_slots array<long>, item_mode int, item_width int")


def contaminations(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(id, item, share, verbatim) for every document and item it holds at least `share` of; each pair once.

    share: part of the item's windows found in consistent occurrences, the greatest of three: of its templates, of
    all windows of words, and of the finer ones. verbatim: no slot has another value. Rows with equal ids count as one
    document. Null and empty texts, and items without a letter or digit, match nothing.
    """
    wanted = benchmark_windows(benchmark, item, item_text, size)
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(wanted.select("hash")))
    kinds = wanted.select((F.col("item_mode") == LETTERS).alias("fine"), "item_width").distinct().collect()
    widths, fine = ([r.item_width for r in kinds if r.fine == f] for f in (False, True))
    names = ["doc", "doc_at", "hash", "doc_slots", "doc_mode", "doc_width"]
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                owner = batch.column(0)[low:high]
                if widths:
                    keys, values, doc, raw = template(data, offsets)
                    begin = _begins(doc, high - low)
                for width in widths:
                    found, use, few = _windows(keys, values, doc, raw, width)
                    at = np.flatnonzero(use)
                    at = at[bloom.value.might_hold(found[at])] if len(at) else at
                    yield _rows(owner, at, doc, begin, found, values, width, np.where(few[at], VALUES, TEMPLATE), names)
                if fine:
                    keys, doc, _ = letters(data, offsets)
                    begin = _begins(doc, high - low)
                for width in fine:
                    found, use = _fine_windows(keys, doc, width)
                    at = np.flatnonzero(use)
                    at = at[bloom.value.might_hold(found[at])] if len(at) else at
                    yield _rows(owner, at, doc, begin, found, np.zeros(0, np.int64), width, np.full(len(at), LETTERS), names)

    hits = docs.select(id, text).mapInArrow(run, f"doc {kind}, doc_at long, hash long, doc_slots array<long>, doc_mode int, doc_width int")
    pairs = hits.join(wanted, "hash").where("doc_width = item_width and doc_mode = item_mode")
    slots = F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda p: p["item_slots"] != 0)
    pairs = pairs.select("doc", "item", F.col("item_mode").alias("mode"), (F.col("doc_at") - F.col("item_at")).alias("diagonal"), "item_at", slots.alias("slots"))
    # One occurrence: at most as many positions and slots as the item has tokens.
    one = pairs.groupBy("doc", "item", "mode", "diagonal").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    same = F.size(F.array_distinct(F.transform("slots", lambda p: p["item_slots"]))) == F.size("slots")
    one = one.where(same).withColumn("verbatim", F.forall("slots", lambda p: p["item_slots"] == p["doc_slots"]))
    # Occurrences of an item in one document are merged by position, not kept side by side.
    places = one.select("doc", "item", "mode", "verbatim", F.explode("places").alias("place")).groupBy("doc", "item", "mode", "place").agg(F.max("verbatim").alias("verbatim"))
    in_mode = lambda column, mode: F.when(F.col(column) == mode, F.lit(1))
    covered = places.groupBy("doc", "item").agg(*(F.count(in_mode("mode", m)).alias(f"n{m}") for m in (TEMPLATE, VALUES, LETTERS)), F.min("verbatim").alias("verbatim"))
    total = wanted.select("item", "item_mode", "item_at").distinct().groupBy("item").agg(*(F.count(in_mode("item_mode", m)).alias(f"t{m}") for m in (TEMPLATE, VALUES, LETTERS)))
    part = lambda n, t: F.when(t > 0, n / t).otherwise(0.0)
    n, t = ([F.col(f"{x}{m}") for m in (TEMPLATE, VALUES, LETTERS)] for x in "nt")
    best = F.greatest(part(n[0], t[0]), part(n[0] + n[1], t[0] + t[1]), part(n[2], t[2]))
    found = covered.join(total, "item").withColumn("share", best).where(F.col("share") >= share)
    return found.select(F.col("doc").alias(id), F.col("item").alias(item), "share", "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", item: str = "item_id", **options) -> DataFrame:
    """One row for each row: id, contaminated, the ascending items found, the ones found re-parameterised, best share.

    A row whose id is null is judged with all others without an id. Repeated rows give a row each; columns that are
    not named are not read, so names cannot clash; an empty table, or an empty benchmark, gives no contamination.
    """
    found = contaminations(docs, benchmark, id, item=item, **options)
    by_doc = found.groupBy(F.col(id).alias("key")).agg(
        F.sort_array(F.collect_set(item)).alias("items"),
        F.sort_array(F.collect_set(F.when(~F.col("verbatim"), F.col(item)))).alias("reparameterised"),
        F.max("share").alias("share"),
    )
    rows = docs.select(id).join(by_doc, F.col(id).eqNullSafe(F.col("key")), "left")
    none = F.array().cast(by_doc.schema["items"].dataType)
    return rows.select(
        id, F.col("share").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"),
        F.coalesce("reparameterised", none).alias("reparameterised"), F.coalesce("share", F.lit(0.0)).alias("share"),
    )
