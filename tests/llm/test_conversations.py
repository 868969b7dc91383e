"""Prefix trie, structure repair and language of texts, against brute force and held-out rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_cnn, structure_repair
from plumbline.llm.language_cnn import Network, predict_language, text_probabilities
from plumbline.llm.prefix_trie import conversation_trie
from plumbline.llm.queries import QUERIES
from plumbline.llm.shared import shared_folder
from plumbline.llm.structure_repair import Conversation, repair_conversations, repaired_turns

TURNS = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """Turns of each conversation as (role, text)."""
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def brute_trie(convs):
    """Rows of conversation_trie from {conv: [(role, text)]}, by walking every node's whole subtree."""
    members = collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p] + [x for q in children[p] for x in below(q)]

    out = set()
    for p, own in members.items():
        tree = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(own), len(p), parent, len(own), len(children[p]), sum(not children[q] for q in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_turns(seed, convs, texts=("", "a", "bb", "ccc")):
    rnd, rows = random.Random(seed), []
    for c in range(convs):
        if rnd.random() < 0.3 and rows:
            rows += [(c, *r[1:]) for r in rows if r[0] == rnd.randrange(c)]
        else:
            rows += [(c, t, rnd.choice(("user", "assistant", None)), rnd.choice((*texts, None))) for t in range(rnd.randrange(1, 7))]
    return rows


@pytest.mark.parametrize("cells", [1 << 16, 4])
def test_trie_matches_brute_force(spark, monkeypatch, cells):
    rows = random_turns(cells, 150) + [(5, None, "user", "x"), (5, None, "user", "x"), (7, 3, "user", None), (None, 1, "user", "lost"), (-3, 0, "user", "a")]
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).repartition(5)
    found = conversation_trie(frame, shared_folder(spark))
    assert {tuple(r) for r in found.collect()} == brute_trie(in_order(rows))


def test_trie_without_shared_prefixes_and_without_rows(spark):
    rows = [(3, 0, "user", "alone"), (3, 1, "assistant", "yes")]
    found = conversation_trie(spark.createDataFrame(rows, TURNS), shared_folder(spark)).collect()
    assert {tuple(r) for r in found} == brute_trie(in_order(rows))
    assert conversation_trie(spark.createDataFrame([], TURNS), shared_folder(spark)).count() == 0


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    rows = [r for c in (0, 1, 2, 17, 100, 101, 150, 305) for r in [(c, t, "user" if t % 2 else "system", f"t{t * (c % 7)}") for t in range(1 + c % 5)]]
    rows += [(42, 0, "user", "one turn only")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    own, built = in_order(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert any(not v for v in built.values())
    found = QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == brute_trie(built)


def test_trie_of_one_long_conversation_and_many_copies(spark):
    long = [(1, t, "user", "x" * (t % 3)) for t in range(3000)]
    rows = long + [(c, t, "user", "hi") for c in range(10, 700) for t in range(2)] + [(2, t, "user", "x" * (t % 3)) for t in range(2900)]
    found = {(r["conv_id"], r["depth"]): r for r in conversation_trie(spark.createDataFrame(rows, TURNS), shared_folder(spark)).collect()}
    assert len(found) == 3000 + 1 + 2
    assert found[1, 0]["n_convs"] == 692 and found[1, 0]["n_leaves"] == 2 and found[1, 2900]["n_convs"] == 2 and found[1, 2901]["n_convs"] == 1
    assert found[10, 2]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 700))).encode()).hexdigest()
    assert found[10, 2]["saved_tokens"] == 689 * 2 and found[10, 1]["saved_tokens"] == 689 * 4
    assert found[1, 0]["saved_tokens"] == 689 * 4 + sum(t % 3 for t in range(2900))


def faults(turns):
    """(role, text, fault) of turns in order."""
    seen, out = set(), []
    for role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(turns, inserts):
    """(cost, audit, repaired) by trying all edits with at most so many insertions in a row."""
    gaps = [()] + [g for n in range(1, inserts + 1) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r), ("R", "user"), ("R", "assistant")]) for r, _, f in turns]
    for ops in itertools.product(*choices):
        cost = sum({"D": 4, "K": 0, "R": 3}[o] + 3 * (o != "D" and f == "truncated") for (o, _), (_, _, f) in zip(ops, turns, strict=True))
        if best and cost > best[0]:
            continue
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            whole = cost + 3 * sum(map(len, put))
            if best and whole > best[0]:
                continue
            audit, out = "I" * len(put[0]), [(r, "") for r in put[0]]
            for (op, role), (_, text, _), gap in zip(ops, turns, put[1:], strict=True):
                audit += op + "I" * len(gap)
                out += ([] if op == "D" else [(role, text)]) + [(r, "") for r in gap]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (whole, audit) < best[:2]):
                best = whole, audit, out
    return best


def test_repairs_match_brute_force(spark):
    rnd, rows = random.Random(3), []
    for c in range(120):
        for t in range(rnd.randrange(1, 4)):
            rows.append((c, t * rnd.choice((1, 1, 3)), rnd.choice(("user", "assistant", "system", "tool", "user")), rnd.choice(("A.", "B", "", "C! \n", "A."))))
    frame = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit(1)).withColumn("fault", F.lit("clash"))
    found = {r["conv_id"]: r for r in repair_conversations(frame).collect()}
    turns = collections.defaultdict(list)
    for r in repaired_turns(frame).orderBy("conv_id", "position").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    ordered = in_order(rows)
    assert found.keys() == ordered.keys()
    for c, own in ordered.items():
        marked, row = faults(own), found[c]
        cost, audit, out = cheapest(marked, 2)
        assert (row["cost"], row["audit"]) == (cost, audit), (c, own)
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest() and turns[c] == out
        assert [row[f] for f in ("blank", "duplicate", "truncated")] == [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        assert row["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        numbers = [t for i, t, _, _ in rows if i == c]
        assert row["gaps"] == max(numbers) - min(numbers) + 1 - len(set(numbers))


def test_repair_of_blank_ids_turns_and_dropped_rows(spark):
    rows = [(None, None, "user", "a."), (None, 5, "assistant", "b."), (1, 1, "user", "gone"), (2, None, None, None), (2, None, "user", "q?"), (3, 9, "user", "q?"), (3, 2, "system", "s.")]
    frame = spark.createDataFrame(rows, TURNS)
    found = {r["conv_id"]: r for r in repair_conversations(frame, absent=F.col("conv_id") == 1).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(found[None])[1:8] == (0, 0, 0, 0, 0, 0, "KK")
    assert tuple(found[1])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert tuple(found[2])[1:8] == (0, 1, 0, 0, 1, 7, "DKI")
    assert tuple(found[3])[1:8] == (6, 0, 0, 0, 0, 3, "KKI")
    assert repair_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_giant_conversation_goes_through_spools(spark, monkeypatch):
    for name, size in (("SPOOL_TURNS", 100), ("SPOOL_FLAGS", 10), ("BLOCK", 7)):
        monkeypatch.setattr(structure_repair, name, size)
    rnd = random.Random(8)
    turns = [(rnd.choice(("user", "assistant", "system")), rnd.choice(("a.", "b", " ", "c?")), rnd.choice((0, 0, 1, 2, 3))) for _ in range(500)]

    def whole():
        one = Conversation("1")
        for k, (role, text, fault) in enumerate(turns):
            one.add(k, role, text, fault)
        return one.summary()

    spooled = whole()
    monkeypatch.undo()
    assert spooled == whole() and len(spooled[7]) >= 500


def test_damage_of_registered_query(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}. End!") for c in range(60) for t in range(6)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in QUERIES["op12_structure_repair"](spark, str(tmp_path)).collect()}
    assert len(found) == 60
    for c in range(60):
        own = []
        for t in range(6):
            role, text, code = ("user", "assistant")[t % 2], f"Text {t}. End!", zlib.crc32(f"{c}:{t}".encode()) % 20
            text = "" if code == 1 else text.translate({46: None, 33: None, 63: None}) if code == 2 else text
            own += [(t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        marked = faults([(r, x) for _, r, x in own])
        assert [found[c][f] for f in ("blank", "duplicate", "truncated")] == [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        if len(own) <= 4:
            assert (found[c]["cost"], found[c]["audit"]) == cheapest(marked, 1)[:2]


def test_language_of_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op13_language_id"](spark, sf).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_rows(spark):
    rows = [(k, ("the words and of this " if k % 2 else "der die das und nicht ") * 8, ("en", "de")[1 - k % 2]) for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "", "en"), (102, "12 34 !?", "de"), (None, "the words and of", None), (103, "und das nicht " * 40000, None), (103, "the and", None)], "doc_id long, text string, lang string")
    found = predict_language(docs.withColumn("score", F.lit("clash")), docs, keep=("lang",)).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] != 103}
    assert len(found) == 66
    assert all(by[k]["lang_pred"] == rows[k][2] for k in range(60))
    assert {by[k]["lang_pred"] for k in (100, 101, 102)} == {"und"} and {by[k]["score"] for k in (100, 101, 102)} == {0}
    assert by[None]["lang_pred"] == "en" and "de" in {r["lang_pred"] for r in found if r["doc_id"] == 103}
    unknown = predict_language(docs, docs.where("lang = 'xx'")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
    assert predict_language(docs.limit(0), docs).count() == 0


def test_gradients_match_differences():
    random_ = np.random.default_rng(1)
    network, windows, labels = Network(3), random_.integers(0, 257, (6, 20)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2])
    network.values = {k: v.astype(np.float64) for k, v in network.values.items()}
    exact = network.gradients(windows, labels)
    loss = lambda: -np.log(network.probabilities(windows)[np.arange(6), labels]).mean()
    for name in ("embed", "filter3", "bias2", "out", "prior"):
        values = network.values[name].reshape(-1)
        for at in np.argsort(-np.abs(exact[name].reshape(-1)))[:4]:
            kept, ends = values[at], []
            for d in (1e-6, -1e-6):
                values[at] = kept + d
                ends.append(loss())
            values[at] = kept
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(exact[name].reshape(-1)[at], rel=1e-3)


def test_a_text_counts_as_a_whole():
    network = language_cnn.train(np.zeros((4, language_cnn.WINDOW), np.int16) + 97, np.array([0, 1, 0, 1]), 2)
    data = np.frombuffer(b"abc xyz " * 100, np.uint8)
    whole = text_probabilities(network, 2, data, np.array([0, 800]))
    parts = text_probabilities(network, 2, data, np.array([0, 384, 800]))
    assert whole[0] == pytest.approx((parts * np.array([[384], [416]])).sum(0) / 800, abs=0.02)
