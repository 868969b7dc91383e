"""Hashes that structured texts cannot break, and page scans that broken markup cannot slow down."""

import random
import re
import time

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import html_text
from plumbline.llm.html_text import main_text
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.packed_ids import read_packed, write_packed
from plumbline.llm.pretokens import PieceTable
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.queries import BYTE_BPE, PIECE_BPE
from plumbline.llm.sentencepieces import encode_pieces
from plumbline.llm.shared import shared_folder
from plumbline.llm.textscan import Hasher, windows
from plumbline.llm.token_counts import Tier, count_tokens

BYTES, PIECES = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)


def thue_morse(order, a="a", b="b"):
    one, two = [a], [b]
    for _ in range(order):
        one, two = one + two, two + one
    return one, two


WORDS = [["".join(x) for x in thue_morse(order)] for order in (10, 12)]
TEXTS = [t for pair in WORDS for t in pair] + [f"{a}\n{b}\n{a}" for a, b in WORDS]


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string")


def test_span_hashes_tell_thue_morse_words_apart():
    for order in range(1, 17):
        one, two = ("".join(x).encode() for x in thue_morse(order))
        n = len(one)
        keys = Hasher(np.frombuffer(one + two, np.uint8)).of(np.array([0, n]), np.array([n, 2 * n]))
        assert keys[0] != keys[1]


def test_window_hashes_tell_thue_morse_words_apart():
    for order in range(1, 6):  # windows have at most twelve words
        one, two = (np.array(x, np.uint64) for x in thue_morse(order, 12345, 67891))
        n = len(one)
        got = [windows(x, np.zeros(n, np.int64), n)[0][0] for x in (one, two)]
        assert got[0] != got[1]


def test_span_hashes_do_not_depend_on_the_place():
    data = np.random.default_rng(3).integers(0, 256, 3 << 20, dtype=np.uint8)
    turned = np.roll(data, -1000)
    whole, part = Hasher(data), Hasher(turned)
    starts = np.array([1000, 2000, 1 << 21])
    ends = np.array([1001, 1 << 20, 3 << 20])
    assert (whole.of(starts, ends) == part.of(starts - 1000, ends - 1000)).all()


def test_tables_compare_bytes(monkeypatch):
    """With a hash that is the same for all, every piece still gets its own ids and length."""
    monkeypatch.setattr(Hasher, "of", lambda self, starts, ends: np.full(len(starts), 7, np.uint64))
    data = np.frombuffer(b"abcab", np.uint8)
    starts, ends = np.array([0, 2, 3, 3]), np.array([2, 3, 5, 4])
    table = PieceTable(lambda pieces: [list(p) for p in pieces])
    for _ in range(2):
        slots = table.slots(data, starts, ends)
        assert bytes(table.gather(slots).astype(np.uint8)) == b"abcaba"
    tier = Tier(b"abc", bytes([2, 1]), bytes([5, 6]))
    assert tier.find(data, starts, ends).tolist() == [5, -1, 5, -1]
    assert Tier(b"", b"", b"").find(data, starts, ends).tolist() == [-1] * 4


def test_ids_of_thue_morse_words(spark, twins):
    library = Tokenizer.from_file(BYTES)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    assert {r.doc_id: r.n_tokens for r in count_tokens(twins, BYTES).collect()} == dict(enumerate(want))
    folder = shared_folder(spark)
    manifest = write_packed(twins, BYTES, folder)
    assert {r.doc_id: r.n_tokens for r in read_packed(manifest, folder).collect()} == {k: n + 1 for k, n in enumerate(want)}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode_pieces(twins, PIECES).collect()}
    assert got == {k: model.encode(t, add_bos=True, add_eos=True) for k, t in enumerate(TEXTS)}


def test_lines_and_sets_of_thue_morse_words(spark, twins):
    rows = {r.doc_id: r.n_dup_lines for r in quality_rules(twins).collect()}
    assert [rows[k] for k in range(6)] == [0, 0, 0, 0, 1, 1]
    sets = jaccard_components(twins.where("doc_id < 4"), shared_folder(spark), size=3, percent=90)
    assert {r.doc_id: r.component_id for r in sets.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def plain_tags(page):
    """The same cuts by one regular expression, which takes quadratic time on broken pages."""
    raw = "script|style|noscript|template|svg|annotation-xml|annotation|textarea|select|iframe|object|title"
    pattern = re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<(?P<raw>(?:{raw}|head(?=[^a-zA-Z0-9:-][^>]*>|>)(?=[^>]*>(?:(?!<body).)*?</head)))(?![a-zA-Z0-9:-])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
        r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>"
        r"|<[!?][^>]*>",
        re.S | re.I,
    )
    for m in pattern.finditer(page):
        name = m["name"]
        yield m.start(), m.end(), (name or "").lower(), bool(name and m["end"]), m["rest"] if name else ""


@pytest.mark.parametrize("near", [6, html_text._NEAR])
def test_tags_match_a_regular_expression(monkeypatch, near):
    monkeypatch.setattr(html_text, "_NEAR", near)
    rng = random.Random(5)
    parts = (
        '<a|<|>|"|\'| |x|<!--|-->|<script|</script>|</script >|<p>|</p>|<div class="q">|</div>|<head>|<head |</head>|<body>|</body>'
        "|<title>|</title>|<!d|=|<br>|text |<main>|<?|<script-x>|<svg|</SVG>"
    ).split("|")
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert list(html_text._Tags(page)) == list(plain_tags(page)), page


BROKEN = {
    "tags": "<a" * 1_000_000, "heads": "<head>" * 350_000, "bodies": "<head>" * 170_000 + "<body>" + "</head>" * 1000,
    "quotes": '<a "' * 500_000, "quoted ends": '<a ">"' * 170_000, "both quotes": "<a \"'>" * 350_000, "comments": "<!--" * 500_000,
    "open containers": "<div>" * 150_000 + "</section>" * 150_000, "attributes": '<div class="' * 170_000, "scripts": "<script" * 300_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_linear_time(kind):
    start = time.process_time()
    main_text(BROKEN[kind])
    assert time.process_time() - start < 8  # the square of these lengths would be hours


TEXT = "The town is the place of the market and it is open to all of you in the morning."


@pytest.mark.parametrize("around", ["<article>{}</article>{}", "<main>{}</main>{}", "<article class='post share'>{}</article>{}", "<main>{}{}</main>"])
@pytest.mark.parametrize("kind", ["comment", "related promo", "ad"])
def test_articles_of_readers_and_promotion_go(around, kind):
    other = f"<article class='{kind}'><p>I think that this is the best of all of them and so on.</p></article>"
    assert main_text(around.format(f"<p>{TEXT}</p><p>{TEXT}</p>", other)) == f"{TEXT} {TEXT}"


def test_an_article_alone_stays_whatever_its_class():
    assert main_text(f"<article class='comment'><p>{TEXT}</p></article>") == TEXT
    assert main_text(f"<main><p>By us</p><article class='related'><p>{TEXT}</p><aside>{TEXT}</aside></article></main>") == f"By us {TEXT}"


def test_formulas_and_topics_stay():
    formula = "<p>E <math><mi>=</mi><annotation>x</annotation></math> mc2 holds in all of the cases that we have looked at so far.</p>"
    assert main_text(f"<article>{formula}</article>") == "E = mc2 holds in all of the cases that we have looked at so far."
    for name in ("notice-board", "social-history", "alert-levels"):
        assert main_text(f"<article><p>{TEXT}</p><div class='{name}'><p>{TEXT}</p></div></article>") == f"{TEXT} {TEXT}"
    for name in ("notice", "site-notice", "notice-box", "social-links", "share", "share-buttons", "cookie-notice", "ad-slot"):
        assert main_text(f"<article><p>{TEXT}</p><div class='{name}'><p>{TEXT}</p></div></article>") == TEXT
