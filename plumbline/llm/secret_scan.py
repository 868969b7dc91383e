"""Secret scan with DataFrame functions only: known shapes, and strings that pass for random.

Known shapes are assignments, access keys and long hexadecimal runs. Other candidates are maximal runs of token
characters with digits or alternating case. Each gets the encoding its characters fit, and three tests of the
hypothesis that it is a uniform random string over that alphabet: chi-squared of the character counts, runs above
and below the middle of the alphabet, and serial correlation of neighbours; Fisher's method combines them. A
candidate is dismissed as not random by Benjamini and Hochberg's rule among all candidates of its encoding and length
band, so short strings are not dismissed by many weak tests; those left, with enough random bits in them, are spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The known shapes. Group 1 of an assignment is its value.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

_RUN = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z][A-Za-z+/_-]*[a-z][A-Z]))[{_RUN}]{{20,}}=*"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, narrowest first: name, what fits it, its alphabet in order. Plain decimal numbers are no candidates.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _LOWER.upper() + "234567"),
    ("lower36", r"^[0-9a-z]+$", _DIGITS + _LOWER),
    ("upper36", r"^[0-9A-Z]+$", _DIGITS + _LOWER.upper()),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", r"^[0-9A-Za-z+/]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
MIN_BITS = 96
FALSE_DISMISSALS = 0.05
#: p-values are rounded up to exp(-k / 10), k at most this; ranks then come from counts in a table of fixed size.
STEPS = 400
#: Matches of a text that are numbered at once.
CHUNK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: the only element of an array is bound to a variable."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array of integers from 0 on: within chunks, then over the chunks' ends.

    An array grows by copying, so only arrays of a chunk's length, and of one element a chunk, are grown.
    """

    def grown(xs: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x))))

    def chunked(xs: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(CHUNK)), lambda low: F.struct(low.alias("low"), F.least(low + CHUNK, F.size(xs)).alias("high")))
        return F.transform(ends, lambda c: grown(F.transform(F.sequence(c["low"], c["high"] - 1), lambda i: F.get(xs, i))))

    def based(chunks: Column) -> Column:
        return _let(
            grown(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1))),
            lambda ends: F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda x: combine(F.coalesce(F.get(ends, k - 1), F.lit(0)), x)))),
        )

    return _let(values, lambda xs: F.when(F.size(xs) <= CHUNK, grown(xs)).otherwise(_let(chunked(xs), based)))


def _matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, whole, value) of the leftmost non-overlapping matches, in code points."""
    found = {"gap": F.split(text, pattern, -1), "whole": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}
    if value_group:
        found["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    empty = F.array().cast("array<struct<start:int,end:int,whole:string,value:string>>")
    # There is one gap more than matches: the text after the last one.
    pairs = F.filter(F.arrays_zip(*(x.alias(n) for n, x in found.items())), lambda p: p["whole"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["whole"])), lambda a, b: a + b)

        def one(p: Column, k: Column, ends: Column) -> Column:
            end = F.get(ends, k)
            return F.struct((end - F.length(p["whole"])).alias("start"), end.alias("end"), p["whole"].alias("whole"), p["value" if value_group else "whole"].alias("value"))

        return _let(ends, lambda ends: F.transform(pairs, lambda p, k: one(p, k, ends)))

    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(empty)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind")))


def known_spans(text: Column) -> Column:
    """Spans of the known shapes, by start and kind."""
    assigned = F.filter(_matches(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)
    return F.concat(_spans(assigned, "assign"), _spans(_matches(text, ACCESS), "access"), _spans(_matches(text, HEX), "hex"))


def _minus_log_tail(z: Column, sides: int) -> Column:
    """-log P(Z > z), or of both tails, of the standard normal, within 1e-7 (polynomial approximation 26.2.17)."""

    def tail(z: Column) -> Column:
        t = F.lit(1.0) / (F.lit(1.0) + 0.2316419 * F.abs(z))
        poly = _let(t, lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
        return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)

    p = _let(F.abs(z), tail) * 2 if sides == 2 else _let(z, tail)
    return -F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p)))


def randomness(token: Column) -> Column:
    """Struct of the inferred encoding (null if none), the length, bits and combined p-value of one candidate."""
    encoding, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fits, alphabet in reversed(ENCODINGS):
        encoding, letters = F.when(token.rlike(fits), name).otherwise(encoding), F.when(token.rlike(fits), alphabet).otherwise(letters)
    encoding = F.when(~token.rlike(r"^[0-9]+$"), encoding)
    body = F.regexp_replace(token, "=+$", "")

    def counted(acc: Column, place: Column) -> Column:
        seen = F.when(acc["last"] == place, acc["seen"] + 1).otherwise(F.lit(1.0))
        return F.struct(place.alias("last"), seen.alias("seen"), (acc["sum"] + 2 * seen - 1).alias("sum"))

    def tests(parts: Column) -> Column:
        places, k, n = parts["places"], parts["k"].cast("double"), F.size(parts["places"]).cast("double")
        pairs = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda i: F.struct(places[i - 1].alias("a"), places[i].alias("b")))
        # The square of a count is the sum of the odd numbers up to it, so sorted places are counted in one go.
        empty = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("seen"), F.lit(0.0).alias("sum"))
        squares = F.aggregate(F.sort_array(places), empty, counted, lambda acc: acc["sum"])
        uneven = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + ((p["a"] * 2 >= parts["k"]) != (p["b"] * 2 >= parts["k"])).cast("double"))
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle)) / ((k * k - 1) / 12) / F.sqrt(n - 1)
        total = _minus_log_tail(uneven, 1) + _minus_log_tail(runs, 2) + _minus_log_tail(serial, 2)
        p = _let(total, lambda y: F.exp(-y) * (1 + y + y * y / 2))
        step = F.least(F.lit(STEPS), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * 10)).cast("int")
        return F.struct(parts["encoding"].alias("encoding"), n.cast("int").alias("n"), (n * F.log2(k)).alias("bits"), step.alias("step"))

    chars = F.filter(F.split(body, ""), lambda c: c != "")
    parts = F.struct(encoding.alias("encoding"), F.transform(chars, lambda c: F.instr(letters, c) - 1).alias("places"), F.length(letters).alias("k"))
    return _let(parts, lambda x: F.when(x["encoding"].isNotNull(), tests(x)))


def _band(encoding: Column, n: Column) -> Column:
    return F.concat_ws(":", encoding, F.floor(F.log2(n)).cast("string"))


def candidates(text: Column) -> Column:
    """Array of (start, end, test) of the text's candidates."""
    return F.transform(_matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), randomness(m["whole"]).alias("test")))


def dismissal_steps(docs: DataFrame, text: str = "text", rate: float = FALSE_DISMISSALS) -> dict[str, int]:
    """For each band of encoding and length: from which step on a candidate is dismissed. Bands without one are absent.

    All candidates of the table count. The p-value of step k is exp(-k / 10); the rule takes the least step whose
    p-value is at most rate times the share of candidates at or beyond it.
    """
    tests = docs.select(F.explode(candidates(F.col(text))).alias("c")).select("c.test.*").where("encoding is not null")
    counts = tests.groupBy(_band(F.col("encoding"), F.col("n")).alias("band"), "step").agg(F.count(F.lit(1)).alias("n"))
    beyond = Window.partitionBy("band").orderBy(F.desc("step"))  # at most STEPS + 1 rows
    ranked = counts.withColumns({"beyond": F.sum("n").over(beyond), "all": F.sum("n").over(Window.partitionBy("band"))})
    passed = ranked.where(F.exp(-F.col("step") / 10) <= rate * F.col("beyond") / F.col("all"))
    return {r["band"]: r["step"] for r in passed.groupBy("band").agg(F.min("step").alias("step")).collect()}


def all_spans(text: Column, steps: dict[str, int]) -> Column:
    """Known spans, and random ones that no known span covers, by start and kind."""
    limits = F.create_map(*(F.lit(x) for pair in sorted({"": STEPS + 1, **steps}.items()) for x in pair))

    def accepted(c: Column) -> Column:
        t = c["test"]
        limit = F.coalesce(limits[_band(t["encoding"], t["n"])], F.lit(STEPS + 1))
        return t["encoding"].isNotNull() & (t["bits"] >= MIN_BITS) & (t["step"] < limit)

    def uncovered(known: Column) -> Column:
        # In the order of starts, known ones first, a candidate is covered if an end so far reaches its own.
        events = F.concat(
            F.transform(known, lambda k: F.struct(k["start"].alias("start"), F.lit(False).alias("new"), k["end"].alias("end"))),
            F.transform(F.filter(candidates(text), accepted), lambda c: F.struct(c["start"].alias("start"), F.lit(True).alias("new"), c["end"].alias("end"))),
        )

        def left(events: Column) -> Column:
            reached = _running(F.transform(events, lambda e: F.when(e["new"], 0).otherwise(e["end"])), lambda a, b: F.greatest(a, b))
            return _let(reached, lambda reached: F.filter(events, lambda e, k: e["new"] & (F.get(reached, k) < e["end"])))

        return _let(F.sort_array(events), left)

    return _let(known_spans(text), lambda known: F.sort_array(F.concat(known, _spans(uncovered(known), "random"))))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), rate: float = FALSE_DISMISSALS, spans: str = "spans") -> DataFrame:
    """One row for each row: id, kept columns, and spans, an array of (start, end, rank, kind) by start and kind.

    Positions are code points, the end exclusive. A null text is read as empty; it and an empty one have no spans.
    Repeated rows give a row each; columns that are not named are not read; an empty table gives an empty result.
    """
    steps = dismissal_steps(docs, text, rate)
    return docs.select(id, *keep, all_spans(F.coalesce(F.col(text), F.lit("")), steps).alias(spans))


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with every span, or chain of overlapping spans, replaced. Spans are in ascending order."""

    def masked(ends: Column, wide: Column) -> Column:
        # Four bytes a code point: a piece is cut out without counting from the beginning of the text.
        def piece(low: Column, high: Column | None = None) -> Column:
            size = (F.length(wide) if high is None else high * 4) - low * 4
            return F.decode(F.substring(wide, low * 4 + 1, size), "UTF-32")

        before = F.transform(spans, lambda s, k: F.struct(F.coalesce(F.get(ends, k - 1), F.lit(0)).alias("at"), s["start"].alias("start"), s["end"].alias("end")))
        kept = F.filter(before, lambda s: (s["start"] >= s["at"]) & (s["end"] > 0))
        pieces = F.transform(kept, lambda s: F.concat(piece(s["at"], s["start"]), F.lit(by)))
        return F.concat(F.array_join(pieces, ""), piece(F.get(ends, F.size(ends) - 1)))

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    done = _let(F.struct(ends.alias("ends"), F.encode(text, "UTF-32").alias("wide")), lambda x: masked(x["ends"], x["wide"]))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
