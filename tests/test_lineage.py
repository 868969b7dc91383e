"""Reachability and risk over edge tables."""

import random

from plumbline.operators import lineage


def reach(edges, start):
    seen, layer, hops = {}, {start}, 0
    while layer:
        hops += 1
        layer = {d for s, d in edges if s in layer} - set(seen)
        seen.update(dict.fromkeys(layer, hops))
    return seen


def test_closure_with_cycles_and_a_hot_node(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    edges += [("hub", f"n{i}") for i in range(40)] + [("n1", "hub")] + edges[:5]
    frame = spark.createDataFrame(edges, "src string, dst string")
    starts = spark.createDataFrame([("n1",), ("n2",), ("absent",), ("n1",)], "start string")
    found = lineage.closure(frame, starts)
    got = {(r.start, r.node): r.hops for r in found.collect()}
    want = {(s, n): h for s in ("n1", "n2") for n, h in reach(edges, s).items()}
    assert got == want
    cyclic = {r.start for r in lineage.on_cycle(found).collect()}
    assert cyclic == {s for s in ("n1", "n2") if s in reach(edges, s)}
    back = {(r.start, r.node) for r in lineage.dependents(frame, starts).collect()}
    turned = [(d, s) for s, d in edges]
    assert back == {(s, n) for s in ("n1", "n2") for n in reach(turned, s)}


def test_closure_longer_than_the_compaction(spark):
    frame = spark.range(lineage.COMPACT_EVERY + 4).selectExpr("id AS src", "id + 1 AS dst")
    starts = spark.createDataFrame([(0,)], "start long")
    got = {r.node: r.hops for r in lineage.closure(frame, starts).collect()}
    assert got == {i: i for i in range(1, lineage.COMPACT_EVERY + 5)}


def test_closure_of_nothing(spark):
    frame = spark.createDataFrame([], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "start string")
    found = lineage.closure(frame, starts)
    assert found.columns == ["start", "node", "hops"]
    assert found.collect() == []


def test_risk_reaches_dependents_only(spark):
    nodes = spark.createDataFrame(
        [("base", "BAD"), ("mid", "OK"), ("top", "OK"), ("free", "OK"), ("loose", "OK"), ("other", "WORSE")],
        "node string, status string",
    )
    edges = spark.createDataFrame(
        [("mid", "base"), ("top", "mid"), ("loose", "nowhere"), ("other", "mid"), ("ghost", "free")],
        "src string, dst string",
    )
    got = {r.node: (r.status, r.reason) for r in lineage.propagate_risk(nodes, edges, "OK", "REVIEW").collect()}
    risk = ("REVIEW", "TRANSITIVE_DEPENDENCY_RISK")
    assert got == {
        "base": ("BAD", None),
        "mid": risk,
        "top": risk,
        "free": ("OK", None),
        "loose": risk,
        "other": ("WORSE", None),
    }


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda frame: calls.append(1) or cut(frame))
    n = 100_000
    frame = spark.range(n).selectExpr("id AS src", "id + 1 AS dst").repartition(8)
    starts = spark.createDataFrame([(0,), (n - 3,)], "start long")
    found = lineage.closure(frame, starts)
    assert found.where("start = 0").selectExpr("count(*)", "sum(hops)", "max(node - hops)").first() == (n, n * (n + 1) // 2, 0)
    assert {r.node: r.hops for r in found.where(f"start = {n - 3}").collect()} == {n - 2: 1, n - 1: 2, n: 3}
    # two tables a round (what is found, longer steps) and three before the first
    assert len(calls) <= 2 * 20 + 3


def test_a_dense_graph_is_not_squared(spark):
    rng = random.Random(5)
    edges = list({(rng.randrange(300), rng.randrange(300)) for _ in range(3000)})
    frame = spark.createDataFrame(edges, "src long, dst long")
    steps = lineage._Steps(frame)
    assert not steps.double() and steps.length == 1
    found = lineage.closure(frame, spark.createDataFrame([(0,), (1,)], "start long"))
    assert {(r.start, r.node): r.hops for r in found.collect()} == {(s, n): h for s in (0, 1) for n, h in reach(edges, s).items()}


def test_cycles_match_mutual_reachability(spark):
    for seed in (1,):
        rng = random.Random(seed)
        n = 60
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 100), (7, 7), (200, 200), (201, None)]
        ahead = {s: set(reach([e for e in edges if e[1] is not None], s)) for s in {x for e in edges for x in e if x is not None}}
        want = {}
        for s, seen in ahead.items():
            if s in seen:
                members = {t for t in seen if s in ahead.get(t, ())}
                want[s] = (min(members), len(members))
        found = lineage.cycles(spark.createDataFrame(edges, "src long, dst long"))
        assert {r.node: (r.component, r.size) for r in found.collect()} == want


def test_cycles_of_chains_and_nothing(spark):
    chain = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst")
    assert lineage.cycles(chain).count() == 0
    assert lineage.cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_no_table_passes_through_the_driver(spark, monkeypatch):
    plans = []
    cut = lineage.cut_lineage

    def seen(frame):
        out = cut(frame)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return out

    def rows(frame):
        got = sorted(tuple(r) for r in frame.collect())
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return got

    monkeypatch.setattr(lineage, "cut_lineage", seen)
    edges = spark.createDataFrame([*((i, i + 1) for i in range(4)), (4, 0), (4, 9), (7, 8), (8, 8)], "src long, dst long")
    assert rows(lineage.cycles(edges)) == [*((i, 0, 5) for i in range(5)), (8, 8, 1)]
    starts = spark.createDataFrame([(7,), (9,)], "start long")
    assert rows(lineage.dependents(edges, starts)) == [(9, i, 5 - i) for i in range(5)]
    nodes = spark.createDataFrame([(i, "BAD" if i == 8 else "OK") for i in range(10)], "node long, status string")
    risky = rows(lineage.propagate_risk(nodes, edges, "OK", "REVIEW").select("node", "status").where("status <> 'OK'"))
    assert risky == [(7, "REVIEW"), (8, "BAD")]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_automation_risk_passes_through_sound_nodes(spark):
    ok, auto = "STRUCTURALLY_EQUIVALENT", "AUTO_CONVERT"
    rows = [
        ("a", ok, "NAME_MATCH", auto, False), ("b", ok, "EXACT_MAPPING", auto, False), ("c", ok, "EXACT_MAPPING", auto, False),
        ("bad", "WRONG", "EXACT_MAPPING", auto, False), ("d", ok, "EXACT_MAPPING", auto, True), ("e", ok, "EXACT_MAPPING", auto, False),
        ("f", "WRONG", "EXACT_MAPPING", auto, False), ("g", ok, "EXACT_MAPPING", auto, False), ("lone", ok, "EXACT_MAPPING", auto, False),
    ]
    nodes = spark.createDataFrame(rows, "node string, status string, resolution string, automation string, kept boolean")
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("d", "bad"), ("d", "a"), ("e", "d"), ("f", "c"), ("g", "f"), ("g", "gone"), ("b", "a")], "src string, dst string"
    )
    states = lineage.propagate_risks(nodes, edges, ok, "REVIEW", "EXACT_MAPPING", auto)
    got = {r.node: (r.status, r.automation, tuple(r.reasons)) for r in states.collect()}
    semantic, automation = lineage.SEMANTIC_RISK, lineage.AUTOMATION_RISK
    assert got == {
        "a": (ok, auto, ()),
        "b": (ok, "REVIEW", (automation,)),
        "c": (ok, "REVIEW", (automation,)),
        "bad": ("WRONG", auto, ()),
        "d": ("REVIEW", "REVIEW", (semantic, automation)),
        "e": ("REVIEW", "REVIEW", (semantic,)),
        "f": ("WRONG", "REVIEW", (automation,)),
        "g": ("REVIEW", "REVIEW", (semantic,)),
        "lone": (ok, auto, ()),
    }
    risks = {(r.node, r.dependency, r.risk) for r in lineage.dependency_risks(states, edges, ok, "EXACT_MAPPING", auto).collect()}
    assert risks == {
        ("b", "a", f"NAME_MATCH:{auto}"), ("c", "b", "EXACT_MAPPING:REVIEW"), ("d", "bad", "WRONG"), ("d", "a", f"NAME_MATCH:{auto}"),
        ("e", "d", "REVIEW"), ("f", "c", "EXACT_MAPPING:REVIEW"), ("g", "f", "WRONG"), ("g", "gone", "UNRESOLVED"),
    }
