"""Secret spans against a plain version, and long texts full of matches."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plumbline.llm import secret_scan as s


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _tested(token: str) -> tuple[str, int, float, int] | None:
    """Encoding, length, random bits and step of a candidate."""
    name, letters = next(((n, a) for n, fits, a in s.ENCODINGS if re.fullmatch(fits.strip("^$"), token)), (None, ""))
    if name is None or token.isdigit():
        return None
    places = [letters.index(c) for c in token.rstrip("=")]
    n, k = len(places), len(letters)
    chi = sum(c * c for c in Counter(places).values()) * k / n - n
    uneven = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    turns = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(places, places[1:], strict=False))
    runs = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    mean = (k - 1) / 2
    serial = sum((a - mean) * (b - mean) for a, b in zip(places, places[1:], strict=False)) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    ps = [_normal_tail(uneven), 2 * _normal_tail(abs(runs)), 2 * _normal_tail(abs(serial))]
    y = -sum(math.log(min(1.0, max(1e-300, p))) for p in ps)
    p = math.exp(-y) * (1 + y + y * y / 2)
    return name, n, n * math.log2(k), min(s.STEPS, math.floor(-math.log(max(p, 1e-300)) * 10))


def _plain(texts: list[str]) -> list[str]:
    """All spans of each text; Benjamini and Hochberg's rule goes through the sorted p-values one by one."""
    tests, bands = [], defaultdict(list)
    for text in texts:
        for m in re.finditer(s.CANDIDATE, text):
            test = _tested(m.group())
            tests.append((text, m.start(), m.end(), test))
            if test:
                bands[test[0], int(math.log2(test[1]))].append(math.exp(-test[3] / 10))
    limit = {}
    for band, ps in bands.items():
        passed = [p for i, p in enumerate(sorted(ps), 1) if p <= s.FALSE_DISMISSALS * i / len(ps)]
        limit[band] = max(passed, default=0.0)
    out = []
    for text in texts:
        known = [(m.start(), m.end(), 0, "assign") for m in re.finditer(s.ASSIGN, text) if len(m.group(1)) >= s.ASSIGN_VALUE]
        known += [(m.start(), m.end(), 1, "access") for m in re.finditer(s.ACCESS, text)] + [(m.start(), m.end(), 2, "hex") for m in re.finditer(s.HEX, text)]
        new = [
            (a, b, 3, "random") for t, a, b, test in tests
            if t is text and test and test[2] >= s.MIN_BITS and math.exp(-test[3] / 10) > limit[test[0], int(math.log2(test[1]))]
            and not any(k[0] <= a and b <= k[1] for k in known)
        ]
        out.append(",".join(f"{kind}:{a}:{b}" for a, b, _, kind in sorted(known + new)))
    return out


def _texts(n: int) -> list[str]:
    rng = random.Random(5)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    pieces = ["getUserNameFromSessionStore2", "a1" * 15, "0123456789abcdefghijklmnopqrst", "password = hunter2x", "api_key: 'é'", "Straße 😀", "AKIA" + "Q7" * 9, "token=" + "f" * 40, "2024-01-01_report_final_version_2"]
    out = []
    for _ in range(n):
        words = [rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(alphabets), k=rng.randint(15, 80))) for _ in range(rng.randint(0, 12))]
        out.append(" ".join(words))
    return out


def test_spans_match_plain_version(spark):
    texts = list(dict.fromkeys(_texts(400)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(s.find_secrets(frame).select("doc_id", s.joined(F.col("spans"))).collect())
    want = _plain(texts)
    assert sum("random" in w for w in want) > 50
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_long_text_of_many_secrets(spark):
    rng = random.Random(7)
    text = " ".join("é " + "".join(rng.choices("0123456789abcdef", k=32)) for _ in range(30_000))
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").cache()
    frame.count()
    began = time.time()
    found = s.find_secrets(frame, keep=("text",))
    rows = {r.doc_id: r for r in found.select("doc_id", s.joined(F.col("spans")).alias("j"), s.mask(F.col("text"), F.col("spans")).alias("masked")).collect()}
    took = time.time() - began
    frame.unpersist()
    assert rows[1].j == ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer(s.HEX, text))
    assert rows[1].masked == re.sub(s.HEX, "[SECRET]", text)
    assert (rows[2].masked, rows[3].masked, rows[2].j, rows[3].j) == ("", None, "", "")
    assert took < 30
    print(f"took {took:.1f}")
