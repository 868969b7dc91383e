"""Operators that join or group documents, against brute force, and the pipeline."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import jaccard_join
from plumbline.llm.blocked_bloom import build_bloom
from plumbline.llm.components import components
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.jaccard_join import jaccard_components, signatures, size_classes
from plumbline.llm.queries import QUERIES, SQL
from plumbline.llm.shared import shared_folder
from plumbline.llm.signature_tree import spanning_links
from plumbline.llm.url_filter import judge_urls


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    """(number of shingles, component) of each id."""
    ids = sorted(i for i, _ in rows)
    sets = {i: shingles(t, size) for i, t in rows}
    place, holders, links = {i: k for k, i in enumerate(ids)}, collections.defaultdict(list), []
    for i in ids:
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        links += [(place[i], place[j]) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            holders[s].append(i)
    root = roots(len(ids), links)
    return {i: (len(sets[i]), ids[root[place[i]]]) for i in ids}


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    rnd, pairs = random.Random(percent), 0
    for _ in range(1500):
        a = {rnd.getrandbits(64) for _ in range(rnd.randrange(1, 90))}
        b = set(a)
        for _ in range(rnd.randrange(len(a) // 3 + 1)):
            if rnd.random() < 0.5 and len(b) > 1:
                b.remove(rnd.choice(sorted(b)))
            else:
                b.add(rnd.getrandbits(64))
        if 100 * len(a & b) >= percent * len(a | b):
            pairs += 1
            both = [np.array(sorted(x), np.uint64) for x in (a, b)]
            found, at = signatures(np.concatenate(both), np.array([0, len(a), len(a) + len(b)]), percent)
            assert set(found[: at[1]].tolist()) & set(found[at[1] :].tolist())
    assert pairs > 100


def test_classes_reach_all_similar_sizes():
    tops, parts, empty = size_classes(80)
    own = lambda n: int(np.searchsorted(tops, n))
    assert all(own(n * 100 // 80) <= own(n) + 1 for n in range(1, 5000))
    assert (parts > empty).all()


def test_tree_links_connect_what_brute_force_connects():
    rnd = random.Random(8)
    for _ in range(60):
        percent = rnd.choice((50, 80, 90, 100))
        bases = [[rnd.getrandbits(64) for _ in range(rnd.randrange(1, 60))] for _ in range(8)]
        sets = []
        for _ in range(rnd.randrange(1, 90)):
            x = set(rnd.choice(bases)) | {rnd.getrandbits(64) for _ in range(rnd.randrange(6))}
            sets.append(np.array(sorted(x), np.uint64))
        n = len(sets)
        true = {(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        links = spanning_links(sets, np.arange(n), percent)
        assert roots(n, links) == roots(n, true) and all((max(x), min(x)) in true for x in links)
        assert len(links) == n - len(set(roots(n, true)))  # a forest, however many copies there are


def near_copies(rnd, n, copies, share):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(rnd.randrange(1, 120))] for _ in range(n)]
    out = []
    for w in base:
        for _ in range(copies):
            x = list(w)
            for _ in range(rnd.randrange(1 + int(share * len(x)))):
                x[rnd.randrange(len(x))] = word()
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 1 << 19), (5, 80, 1 << 19), (3, 80, 300)])
def test_join_matches_brute_force(spark, monkeypatch, size, percent, block):
    """With small blocks, clusters are cut into many and joined across them."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rnd = random.Random(size)
    texts = near_copies(rnd, 25, 12, 0.03) + ["", None, "a", "a b", "A b", "b a", "a b c"] + ["hot copy of one text " * 5] * 60
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, shared_folder(spark), size=size, percent=percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_family_of_many_blocks_with_a_stranger_is_not_paired_block_by_block(spark, monkeypatch):
    """All but one set are connected, so each is compared with the stranger only, and the parts follow what is sent."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1000)
    sent, join = [], jaccard_join._tree_join
    monkeypatch.setattr(jaccard_join, "_tree_join", lambda rows, tasks, *rest: (sent.append((rows.count(), tasks)), join(rows, tasks, *rest))[1])
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        x = list(base)
        x[rnd.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(x)))
    rows.append((500, " ".join(base[:60] + [f"far{k}" for k in range(12)] + base[72:])))  # shares parts, not 90 %
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, shared_folder(spark)).collect()}
    assert got == brute_components(rows, 3, 90) and got[500][1] == 500
    (_, first), (again, second) = sent
    assert first >= 2 * 120 * 140 // 1000 and second >= 2 * 120 * 140 // 1000
    assert 120 <= again <= 121 + first // 2  # the family once, the stranger once for each block


def test_spare_parts_follow_the_size():
    tops, parts, empty = size_classes(80)
    large = (tops > 1 << 18) & (tops < 1 << 30)
    assert large.any() and (empty[large] > 1 << 10).all() and (parts > empty).all()


def test_join_on_nulls_repeats_and_nothing(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z"), (None, None)], "doc_id long, text string")
    got = jaccard_components(frame, shared_folder(spark))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == [
        ("1", 2, "1"), ("1", 2, "1"), ("2", 1, "2"), ("None", 0, "None"), ("None", 2, "None")]
    assert jaccard_components(frame.limit(0), shared_folder(spark)).count() == 0


def test_join_of_an_id_with_two_texts(spark):
    """Rows of one id belong together, and so does all that one of its texts is linked with."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (9, b), (9, c + " end"), (12, c), (20, "alone here now")]
    for some, want in ((rows, {1: 1, 7: 1, 9: 1, 12: 1, 20: 20}), ([(3, a), (3, b), (4, "alone here now")], {3: 3, 4: 4})):
        frame = spark.createDataFrame(some, "doc_id long, text string")
        got = jaccard_components(frame, shared_folder(spark)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, want[i]) for i, _ in some)


def test_join_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, sf).collect()}
    assert got == brute_components(rows, 3, 90)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bloom = build_bloom(keys.union(spark.sql("select cast(null as bigint)")))
    assert bloom.might_hold(np.array([r.k for r in keys.collect()])).all()
    others = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    assert bloom.might_hold(others).mean() < 0.05
    assert not build_bloom(keys.limit(0)).might_hold(others).any()


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_url_rules_and_list(spark):
    urls = [
        "https://m.A.Example.NET/en/1?x", "http://example.net/de/", "http://notexample.net/en/", "x://b.example.com/de/3", "x://b.example.com/d",
        "https://www.site.org/a/index.html?utm_source=q&b=2&a=1#top", "http://site.org/a/?a=1&b=2", "http://site.org/a?a=1", "nothing", None, "", "http://", "http://org/fr/#x",
    ]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)] + [(6, urls[6], "v")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("HTTP://SITE.org/a?b=2&a=1",), (None,), ("x://b.example.com/de/3",), ("nothing",)], "url string")
    got = {r.page_id: r for r in judge_urls(pages, listed, RULES).collect()}
    assert judge_urls(pages, listed, RULES).count() == pages.count()
    assert [(got[k].rule, got[k].verdict) for k in range(5)] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow")]
    assert [got[k].verdict for k in range(5, 12)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[0].host == "m.a.example.net" and got[0].path == "/en/1" and got[9].host == got[9].path == "" and got[12].rule == "org/fr/"
    assert {r.verdict for r in judge_urls(pages, listed.limit(0), RULES).where("rule is null").collect()} == {"allow"}
    assert judge_urls(pages.limit(0), listed, RULES).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    want = con.sql(SQL[name]).select(*columns).fetchall()
    assert sorted(map(repr, map(tuple, out.select(columns).collect()))) == sorted(map(repr, want))


ITEM = "In the market Anna buys 12 apples and 3 kg of flour, then Anna sells 12 pears to her friend Tom for 5 dollars."


def test_templates_and_slots(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "a b"), (3, "so what is that thing"), (4, None), (1, ITEM)], "item_id int, text string")
    texts = [
        "Q. " + ITEM.replace("Anna", "Bob").replace("12", "40").replace("3 kg", "7 lb") + " Ok.",  # other values, used alike
        ITEM.replace("Anna sells 12", "Jim sells 41"),  # one value stands for two
        "x " + ITEM.upper().replace("ANNA", "Anna").replace("TOM", "Tom"), "So, what is that -- thing?", None, "", "filler " * 20_000 + ITEM, "In the market",
    ]
    docs = spark.createDataFrame([(k, t, []) for k, t in enumerate(texts)] + [(None, texts[0], [])], "doc_id long, text string, items array<int>")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert [got[k]["items"] for k in range(8)] == [[1], [], [1], [3], [], [], [1], []] and got[None]["items"] == [1]
    assert got[0].reparameterised == [1] and got[2].reparameterised == [] and got[6].share == 1
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate(docs.limit(0), items).count() == 0


def test_items_of_numbers_names_or_few_words(spark):
    """Exact copies are found even where hardly a word is literal or no blank parts the words."""
    items = ["3 5 8 13 21 34 55 89 144", "Then Anna, Bob, Carl, Dora, Emil and Fritz", "日本の首都はどこですか。その人口は何人ですか？", "光合成とは", "Mitochondria?", "12 + 7", "...", "กรุงเทพ"]
    texts = [
        "next: 3 5 8 13 21 34 55 89 144 ok", "so 4 6 9 14 22 35 56 90 145 ok", "we met. Then Anna, Bob, Carl, Dora, Emil and Fritz left", "問題：日本の首都はどこですか。その人口は何人ですか？答え",
        "では光合成とは何か", "the mitochondria, of course", "so 12 + 7 is", "... 7 12", "日本の人口は多い", "about 12 apples", "ไปกรุงเทพวันนี้",
    ]
    items = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert [got[k]["items"] for k in range(11)] == [[0], [], [1], [2], [3], [4], [5], [], [], [], [7]]
    assert got[0].share == got[3].share == 1 and not any(r.reparameterised for r in got.values())


def brute_items(rows, items, size=6, share=0.3):
    """Literal windows only: the supplied benchmark has no numbers, names or units."""
    norm = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    index, total = collections.defaultdict(set), {}
    for i, t in items:
        w = norm(t)
        total[i] = len(w) - size + 1
        for k in range(total[i]):
            index[tuple(w[k : k + size])].add((i, k))
    out = {}
    for d, t in rows:
        w, hits = norm(t), collections.defaultdict(set)
        for k in range(len(w) - size + 1):
            for i, p in index.get(tuple(w[k : k + size]), ()):
                hits[i].add(p)
        out[d] = sorted(i for i, p in hits.items() if len(p) >= share * total[i])
    return out


def test_decontamination_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r["items"] for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    assert got == brute_items(rows, items)


def test_pipeline_stages_agree_with_brute_force(spark, sf):
    """Each stage against a plain version on its own input; run() gives the last one's rows."""
    folder, docs, seen = shared_folder(spark), spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append((before, {r.doc_id: r for r in docs.collect()}))
    scores = {r.doc_id: r.predicted for r in QUERIES["op4_neighbour_quality"](spark, sf).collect()}
    assert set(seen[0][1]) == {i for i, p in scores.items() if p == 1}
    groups = brute_components([(i, r.text) for i, r in seen[1][0].items()], 5, 80)
    assert set(seen[1][1]) == {i for i, (_, c) in groups.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(seen[2][1]) == {i for i, x in brute_items([(i, r.text) for i, r in seen[2][0].items()], items).items() if not x}
    for i, r in seen[3][1].items():
        old = seen[3][0][i]
        assert (r.text == old.text) == ("[SECRET]" not in r.text) and len(r.text) == r.n_chars
        assert not re.search(r"[0-9a-f]{24}", r.text)
    assert set(seen[3][1]) == set(seen[3][0]) == set(seen[4][1])
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.ids_sha256 for r in seen[4][1].values())


def test_stages_take_odd_rows(spark, sf):
    """Nulls, empty texts, repeated rows and no rows at all pass through every stage."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    counts = {"n-gram Jaccard join": 3, "benchmark decontamination": 6, "secret scans": 6, "SentencePiece encoding and decoding": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).count()
        assert out == counts.get(name, out)
        assert stage(spark, docs.limit(0), sf).count() == 0
