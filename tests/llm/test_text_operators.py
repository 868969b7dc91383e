"""Operators that work text by text, against plain versions of their rules."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.html_text import extract_text, main_text
from plumbline.llm.neighbour_quality import NEIGHBOURS, RANK, TERMS, Sample, fit_space, labelled_sample, score_quality, unit
from plumbline.llm.packed_ids import Reader, opened, pack, read_packed, unpack, write_packed
from plumbline.llm.pretokens import byte_level_starts, plain
from plumbline.llm.quality_rules import distance, quality_rules
from plumbline.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES
from plumbline.llm.secret_scan import find_secrets, joined, mask
from plumbline.llm.sentencepieces import PieceEncoder, encode_pieces
from plumbline.llm.shared import shared_folder
from plumbline.llm.textscan import text_chunks
from plumbline.llm.token_counts import count_tokens

BYTES, PIECES = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
ODD = [
    "", None, "a", "  a  b ", "\t\nq  ", "日本 語", "x▁y ▁", "🙂 é’s it's", "<|endoftext|>", "a<|endoftext|> b", "a\xa0b", "é" * 60_000,
    "the cat sat on the mat " * 40, "same text", "same text",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and other columns named like results."""
    rows = [(None if k == 2 else k, t, None if k % 2 else "en", -1, "x") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, n_tokens int, spans string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_text(frame, source, id="doc_id"):
    return {r[id]: r for r in frame.collect()}


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_match_plain_counts(spark, docs, odd):
    for frame in (docs, odd):
        got = quality_rules(frame).drop("class_distance", "word_distance").collect()
        texts = collections.defaultdict(list)
        for r in frame.collect():
            texts[r.doc_id].append(r.text)
        assert len(got) == frame.count()
        for r in got:
            assert tuple(r[1:6]) == base_rules(texts[r.doc_id][0])
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules(odd.limit(0)).count() == 0


def test_quality_rules_separate_odd_documents(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(2, 9)))
    text = lambda: " ".join(rnd.choice(["the", "of", "and", word(), word()]) for _ in range(150)) + "."
    rows = [(k, text(), "en") for k in range(60)]
    rows += [(100, text().replace(" ", "### "), "en"), (101, text().upper(), "en"), (102, text().replace(" ", " | "), "en"), (103, "A### B&&&", "en")]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k] for k in range(60)) and not any(kept[k] for k in range(100, 104))


def test_jensen_shannon_distance():
    counts = np.array([[1, 0], [1, 1], [0, 0]])
    assert np.allclose(distance(counts, np.array([[0, 3], [2, 2], [1, 1]])), [1, 0, 0])


def known(t):
    t = t or ""
    a = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    b = [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{x}:{y}" for x, _, k, y in sorted(a + b + c))


def test_secrets_match_regular_expressions(spark, docs):
    rnd = random.Random(4)
    parts = ["password", "Token", "api_key", "secret", "=", ":", " ", "'", '"', "AKIA", "ab12", "Z9" * 9, "0f" * 13, "é🙂", "ſecret", "token=", "x" * 6, "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None, "", "AKIAAKIA" + "Z" * 15, "k=" * 9000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.select(-F.col("doc_id") - 1, "text"))
    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    out = find_secrets(frame, keep=("text",)).select("text", base.alias("base"), joined(F.col("spans")).alias("all"), mask(F.col("text"), F.col("spans")).alias("masked")).collect()
    assert all(r.base == known(r.text) for r in out) and len(out) == len(texts) + docs.count()
    assert [r for r in out if (r.text == r.masked) != (not r.all)] == []


def test_random_strings_are_found_and_readable_ones_are_not(spark):
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["key " + "".join(rnd.choice(letters) for _ in range(40)) + " end" for _ in range(40)]
    plain_ = ["abababababababababab1212121212121212ab", "see 12345678901234567890123", "thereforenotwithstandinganything", "A1" * 20] * 10
    frame = spark.createDataFrame(list(enumerate(texts + plain_)), "doc_id long, text string")
    got = {r.doc_id: r.j for r in find_secrets(frame).select("doc_id", joined(F.col("spans")).alias("j")).collect()}
    assert sum(got[k] == "random:4:44" for k in range(40)) >= 37
    assert not any("random" in got[k] for k in range(40, 80))
    assert find_secrets(frame.limit(0)).count() == 0


def test_secret_query_digest(spark, sf):
    for row in QUERIES["op2_secret_scan"](spark, sf).collect():
        spans = [s for s in row.spans.split(",") if s and not s.startswith("random")]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert len(spans) == row.n_assign + row.n_access + row.n_hex


def test_pretokens_match_the_pattern():
    import regex

    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    letters = list("ab sS tdmrevl  \n\t''''0912.,#é ÀɏĀ\r\x0b")
    for _ in range(200):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(20)]
        for low, high, data, offsets in text_chunks(pa.array(texts), 64):
            if len(data):
                assert plain(data, offsets).all()
                starts = byte_level_starts(data, offsets).tolist()
                got = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
                assert got == [x for t in texts[low:high] for x in pattern.findall(t)]


def test_token_counts_match_the_library(docs, odd):
    library = Tokenizer.from_file(BYTES)
    for frame in (docs, odd):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        want = sorted((repr(i), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
        for limit in (8, 1 << 14):
            assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(frame, BYTES, limit=limit).collect()) == want
    assert count_tokens(odd.limit(0), BYTES).count() == 0


def test_pieces_match_the_library_with_spans(docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    frame = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    out = encode_pieces(frame, PIECES, keep=("text",)).collect()
    assert len(out) == frame.count()
    for r in out:
        text = r.text or ""
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
        begins, ends = np.frombuffer(r.begins, "<u4").tolist(), np.frombuffer(r.ends, "<u4").tolist()
        if len(text) < 2000:  # every byte of the source is covered, in order
            raw, covered = text.encode(), set()
            for a, b in zip(begins, ends, strict=True):
                assert 0 <= a <= b <= len(raw)
                covered.update(range(a, b))
            assert covered == set(range(len(raw)))
    assert encode_pieces(odd.limit(0), PIECES).count() == 0


def test_text_by_text_encoding_agrees_with_words():
    encoder = PieceEncoder(PIECES)
    for text in [t for t in ODD if t and len(t) < 1000]:
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        words, whole = encoder.encode(data, offsets), encoder._texts(data.tobytes(), offsets, [0])
        assert all(np.array_equal(a, b) for a, b in zip(words, whole, strict=True)), text


def test_character_map_takes_the_longest_entry():
    """A double array built by hand: "a" becomes "x", "ab" becomes "yz"."""
    from plumbline.llm.sentencepieces import CharacterMap

    texts = b"x\0yz\0"
    units = [0] * 1024
    base = lambda at, to: (at ^ to) << 10
    units[0] = base(0, 256)
    node_a = 256 ^ ord("a")
    units[node_a] = base(node_a, 512) | ord("a") | 1 << 8
    units[512] = 0 | 1 << 31
    node_b = 512 ^ ord("b")
    units[node_b] = base(node_b, 768) | ord("b") | 1 << 8
    units[768] = 2 | 1 << 31
    blob = np.array(units, "<u4").tobytes()
    chars = CharacterMap(np.uint32(len(blob)).tobytes() + blob + texts)
    norm, begins, ends = chars.apply("caab é".encode())
    assert norm == "cxyz é".encode()
    assert begins.tolist() == [0, 1, 2, 2, 4, 5, 5] and ends.tolist() == [1, 2, 4, 4, 5, 7, 7]


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert len(pack(ids, bits)) == -(-1001 * bits // 8) and (unpack(pack(ids, bits), bits, 1001) == ids).all()


def test_packed_files_hold_the_corpus_in_order(spark, docs, odd):
    library = Tokenizer.from_file(BYTES)
    for frame, size in ((docs.repartition(3), 1 << 16), (odd, 1 << 14)):
        folder = shared_folder(spark)
        manifest = write_packed(frame, BYTES, folder, shard_bytes=size)
        rows = read_packed(manifest, folder).orderBy("start").collect()
        texts = collections.defaultdict(list)
        for r in frame.collect():
            texts[r.doc_id].append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == frame.count()
        start = 0
        for r in rows:
            assert r.start == start and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in texts[r.doc_id]
            start += r.n_tokens
        shard = manifest.orderBy("shard").first()
        reader = Reader(opened(folder)[0], shard.path)
        k = len(reader.docs) // 2
        assert reader.document(k).astype("<u4").tobytes() == bytes(rows[k].ids)
    empty = shared_folder(spark)
    assert read_packed(write_packed(odd.limit(0), BYTES, empty), empty).count() == 0


def test_neighbour_votes(spark, sf, docs, odd):
    out = QUERIES["op4_neighbour_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)
    good = " ".join(f"word{k} the of" for k in range(30))
    rows = [(k, good if k % 2 else "A### B### C###", k % 2) for k in range(2 * NEIGHBOURS + 2)]
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scores = {r.doc_id: r.score for r in score_quality(train.union(odd.select(F.col("doc_id") + 1000, "text", F.lit(0))), train).collect()}
    assert scores[1] > 0.99 and scores[0] < 0.5
    assert scores[1000] == scores[1001] == pytest.approx(0.5)  # empty and null texts: the prior
    assert score_quality(odd, train.limit(0)).where("score <> 0.5").count() == 0
    assert score_quality(odd.limit(0), train).count() == 0


def test_the_fit_is_small_in_the_driver(spark):
    """The sample and its fit take less than three arrays of the sample's dense term counts; the space is the plain one."""
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", k), F.lit(900)).cast("string")))
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = docs.select("doc_id", "quality")
    tracemalloc.start()
    try:
        sample = labelled_sample(docs, labels, "doc_id", "text", "quality")
        space = fit_space(sample)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert isinstance(sample, Sample) and len(sample.labels) == 4096
    assert peak < 3 * 4096 * TERMS * 4
    counts = np.zeros((4096, TERMS), np.float32)
    counts[np.repeat(np.arange(4096), sample.sizes), sample.places] = sample.values
    weights = np.log(4097 / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    rows = unit(np.log1p(counts) * weights)
    axes = np.ascontiguousarray(np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :RANK])
    assert np.array_equal(space.weights, weights) and np.array_equal(space.axes, axes)
    assert np.array_equal(space.vectors, unit(rows @ axes))


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies to
give you the best of the experience and so on for all of you today.</div><main><article><h2>Head&nbsp;line</h2><p>Short.</p><p>The text
of the <a href=x>article</a> is long &amp; enough to be of use for the test of this and that.</p><aside>Also read</aside>
<ul class="share-links"><li><a>Tweet</a></ul><p>End</p><section class="comments"><article><p>I think that this is the best of all the
texts in the world and more</p></article></section></article></main><form><label>Mail</label></form><script>if(a<b){"</p>"}</script>
<footer>&copy; x</footer>"""


def test_pages(spark):
    text = "Head line Short. The text of the article is long & enough to be of use for the test of this and that. End"
    assert main_text(PAGE) == text
    long = "the cat of a house is " * 8
    assert main_text(f'<div><a href="/">Home</a> <a>News</a></div><h1>Title</h1><p>{long}</p><p>so it is</p><p>by me</p><div><a>x</a></div>') == f"Title {long}so it is"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, ""), (None, "v", "", None), (3, "w", "<p>a<", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(frame).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:4]] == [(1, text, len(text))] * 2 + [(2, "", 0), (None, "", 0)]
    assert extract_text(frame.limit(0)).count() == 0


RUSSIAN = "Вчера вечером жители города собрались на главной площади, чтобы обсудить новый план развития парка. " * 4
POLISH = "Wczoraj wieczorem mieszkańcy miasta zebrali się na głównym placu, aby omówić nowy plan rozwoju parku. " * 4
GREEK = "Χθες το βράδυ οι κάτοικοι της πόλης συγκεντρώθηκαν στην κεντρική πλατεία για να συζητήσουν το σχέδιο. " * 4
JAPANESE = "昨日の夜、町の住民は公園の新しい計画について話し合うために中央広場に集まりました。" * 4
ENGLISH = "This is the note of the owner of the site and it is for all of you that read it with us in the morning. " * 2


@pytest.mark.parametrize("text", [RUSSIAN, POLISH, GREEK, JAPANESE], ids=["russian", "polish", "greek", "japanese"])
def test_pages_in_languages_without_a_stop_word_list(text):
    """A page without <article> keeps its text, and not its links; short paragraphs too, and beside an English block."""
    text, one = text.strip(), text.strip()[: len(text) // 4].strip()
    links = "<div>" + "".join(f'<a href="/{k}">{text[:30]}</a> ' for k in range(20)) + "</div>"
    footer = f"<footer><p>{text}</p></footer>"
    assert main_text(f"<body>{links}<div><p>{text}</p></div>{links}{footer}</body>") == text
    assert main_text(f"<body>{links}<div><p>{one}</p><p>{one}</p></div>{links}{footer}</body>") == f"{one} {one}"
    assert text in main_text(f"<body>{links}<div><p>{text}</p><p>{text}</p></div><div>{ENGLISH}</div></body>")


def test_english_pages_are_judged_by_stop_words():
    """Long lists without function words beside an English text are still no text."""
    words = " ".join(f"Keyword{k}" for k in range(40))
    assert main_text(f"<body><div>{words}</div><h1>Title</h1><p>{ENGLISH}</p></body>").endswith(ENGLISH.strip())
    assert "Keyword" not in main_text(f"<body><div>{words}</div><h1>Title</h1><p>{ENGLISH}</p></body>")


def test_pages_keep_their_article(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op10_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
