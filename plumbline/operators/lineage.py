"""Reachability over an edge table ``(src, dst)``: src depends on dst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Rounds kept as separate files before they are written as one.
COMPACT_EVERY = 16
# Steps are doubled as long as that leaves at most so many times the edges.
ROOM = 4
# Reasons and the statuses that let a definition be converted.
SEMANTIC_RISK = "TRANSITIVE_DEPENDENCY_RISK"
AUTOMATION_RISK = "TRANSITIVE_DEPENDENCY_AUTOMATION_RISK"
UNRESOLVED = "UNRESOLVED"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Checkpoint to the folder of ``spark.checkpoint.dir``."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def _dealt(frame: DataFrame) -> DataFrame:
    """For a side of a join: both sides are dealt by key. As a broadcast, which
    Spark prefers for small tables, every table of every round would pass
    through the driver."""
    return frame.hint("merge")


class _Steps:
    """Pairs of nodes that are ``length`` edges apart.

    Doubling joins the pairs with themselves. A chain, a forest or a ring keeps
    as many pairs as it has edges, however often that is done. Where the join
    would make many more (its size is known from the degrees beforehand), the
    steps stay as long as they are.
    """

    def __init__(self, edges: DataFrame, loops: bool = False):
        self.loops = loops
        self.pairs = cut_lineage(edges.select("src", "dst").distinct())
        self.length = 1
        self.growing = True
        self.room = ROOM * self.pairs.count()

    def double(self) -> bool:
        if self.growing:
            into = self.pairs.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("a"))
            out = self.pairs.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("b"))
            size = into.join(_dealt(out), "mid").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
            self.growing = size <= self.room
            if self.growing:
                first = self.pairs.select("src", F.col("dst").alias("mid"))
                second = self.pairs.select(F.col("src").alias("mid"), "dst")
                pairs = first.join(_dealt(second), "mid").select("src", "dst").distinct()
                # No shortest way comes back to where it began.
                self.pairs = cut_lineage(pairs if self.loops else pairs.where("src <> dst"))
                self.length *= 2
        return self.growing


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds`` has ``node`` and any keys; returns the keys, every node that
    is a seed of the keys or reachable from one, and ``hops``, the fewest edges.

    After a round everything within ``reached`` edges is known. Steps of at
    most ``reached + 1`` edges lead on without a gap, so while steps can be
    doubled a way of D edges takes log D rounds. When they cannot, only what
    the last round found is expanded, ``length`` edges at a time.
    """
    keys = [c for c in seeds.columns if c != "node"]
    steps, reached = _Steps(edges), 0
    last = cut_lineage(seeds.distinct().withColumn("hops", F.lit(0)))
    rounds = [last]
    while True:
        # The last `length` layers are enough; while steps grow, those are all.
        wide = _union(rounds) if steps.length == reached + 1 else last
        step = (
            wide.join(_dealt(steps.pairs), F.col("node") == F.col("src"))
            .select(*keys, F.col("dst").alias("node"), (F.col("hops") + steps.length).alias("hops"))
            .groupBy(*keys, "node")
            .agg(F.min("hops").alias("hops"))
            .join(_dealt(_union(rounds)), [*keys, "node"], "left_anti")
        )
        last = cut_lineage(step)
        if last.isEmpty():
            return _union(rounds)
        rounds.append(last)
        reached += steps.length
        if len(rounds) == COMPACT_EVERY:
            rounds = [cut_lineage(_union(rounds))]
        if steps.growing:
            steps.double()


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything reachable from each start: ``(start, node, hops)``.

    ``starts`` has a column ``start``. A start that reaches itself is on a
    cycle. Edges without one of their ends lead nowhere. Chains of any length
    take a few rounds (see ``_spread``); cycles end. The result has one row for
    each start and node it reaches: with every node as a start it can grow with
    the square of the nodes.
    """
    edges = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    first = starts.select("start").distinct().join(_dealt(edges), F.col("start") == F.col("src"))
    found = _spread(edges, first.select("start", F.col("dst").alias("node")))
    return found.select("start", "node", (F.col("hops") + 1).alias("hops"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependents(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The closure against the direction of the edges."""
    return closure(_turned(edges), starts)


def on_cycle(reached: DataFrame) -> DataFrame:
    return reached.where(F.col("start") == F.col("node")).select("start")


def _least_reachable(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``(node, name)``: the least node, in the order of its hash, that can be
    reached from each node or is the node."""
    steps = _Steps(edges)
    least = cut_lineage(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias(name)))
    while True:
        ahead = steps.pairs.join(_dealt(least.withColumnRenamed("node", "dst")), "dst").groupBy("src").agg(F.min(name).alias("other"))
        both = least.join(_dealt(ahead.withColumnRenamed("src", "node")), "node", "left")
        both = cut_lineage(both.select("node", F.least(name, "other").alias("new"), (F.col("other") < F.col(name)).alias("less")))
        changed = not both.where("less").isEmpty()
        least = both.select("node", F.col("new").alias(name))
        if not changed:
            return least
        steps.double()


def _amid(edges: DataFrame) -> DataFrame:
    """Nodes with a long way out and a long way in, as all nodes on a cycle
    have: chains and forests end sooner than steps can be doubled."""
    steps, most = _Steps(edges, loops=True), edges.count()
    while steps.length <= most and not steps.pairs.isEmpty() and steps.double():
        pass
    into = steps.pairs.select(F.col("dst").alias("node"))
    return steps.pairs.select(F.col("src").alias("node")).distinct().join(_dealt(into), "node", "left_semi")


def cycles(edges: DataFrame) -> DataFrame:
    """``(node, component, size)`` of every node on a cycle; ``component`` is
    the least node that it reaches and that reaches it.

    Nodes without a long way out and in are left aside. Each other node gets
    the least node ahead of it and the least one behind it.
    Where both are the same node, all who have it are one component. An edge
    between nodes with different pairs is on no cycle and is dropped. What is
    left is done again; hashes decide what is least, so chains fall apart fast.
    """
    edges = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    found = [edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("of"))]
    while True:
        nodes = _amid(edges)
        edges = edges.join(_dealt(nodes.withColumnRenamed("node", "src")), "src", "left_semi")
        edges = cut_lineage(edges.join(_dealt(nodes.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst"))
        if edges.isEmpty():
            break
        ahead = _least_reachable(nodes, edges, "ahead")
        marks = cut_lineage(ahead.join(_dealt(_least_reachable(nodes, _turned(edges), "behind")), "node"))
        found.append(marks.where("ahead = behind").select("node", F.col("ahead.n").alias("of")))
        open_ = marks.where("ahead <> behind")
        a = open_.select(F.col("node").alias("src"), F.col("ahead").alias("a1"), F.col("behind").alias("b1"))
        b = open_.select(F.col("node").alias("dst"), F.col("ahead").alias("a2"), F.col("behind").alias("b2"))
        kept = edges.join(_dealt(a), "src").join(_dealt(b), "dst").where("a1 = a2 AND b1 = b2")
        edges = cut_lineage(kept.select("src", "dst"))
    # A self-loop inside a larger component belongs to that one, a node with nothing but its loop to itself.
    members = _union(found[1:] + [found[0].join(_dealt(_union(found[1:])), "node", "left_anti")]) if found[1:] else found[0]
    sizes = members.groupBy("of").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    loops = found[0].select("node", F.lit(True).alias("loop"))
    looped = members.join(_dealt(sizes), "of").join(_dealt(loops), "node", "left")
    return looped.where("size > 1 OR loop").select("node", "component", "size")


def _tainted(edges: DataFrame, bad: DataFrame) -> DataFrame:
    """The bad nodes and all that depend on them."""
    return _spread(_turned(edges), bad.select("node")).select("node")


def propagate_risk(nodes: DataFrame, edges: DataFrame, sound: str, risky: str) -> DataFrame:
    """Push risk up the edges: ``nodes(node, status)`` whose status is ``sound``
    become ``risky`` when something they depend on, directly or not, is not
    sound or does not exist. Returns node, status and reason."""
    edges = cut_lineage(edges.select("src", "dst").distinct())
    bad = nodes.where(F.col("status") != sound).select("node")
    hit = _tainted(edges, bad.union(_unresolved(nodes, edges))).withColumn("__hit", F.lit(True))
    marked = nodes.join(_dealt(hit), "node", "left")
    pushed = (F.col("status") == sound) & F.col("__hit").isNotNull()
    return marked.select(
        "node",
        F.when(pushed, risky).otherwise(F.col("status")).alias("status"),
        F.when(pushed, SEMANTIC_RISK).alias("reason"),
    )


def _unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that depend on something that does not exist."""
    missing = edges.join(_dealt(nodes.select(F.col("node").alias("dst"))), "dst", "left_anti")
    return missing.select(F.col("src").alias("node")).join(_dealt(nodes.select("node")), "node", "left_semi").distinct()


def propagate_risks(
    nodes: DataFrame, edges: DataFrame, sound: str, risky: str, exact: str, automatic: str
) -> DataFrame:
    """Both kinds of risk at their fixed point.

    ``nodes`` has node, status, resolution, automation and ``kept`` (true:
    semantic risk leaves its automation alone). Semantic risk goes up the edges
    as in ``propagate_risk`` and turns automation to ``risky`` too. A node that
    is sound in the end but not ``exact`` or not ``automatic`` is an automation
    risk to what depends on it, which then is no longer ``automatic`` and, if
    sound, passes it on. Returns node, status, resolution, automation, reasons.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    semantic = propagate_risk(nodes.select("node", "status"), edges, sound, risky)
    state = nodes.drop("status").join(_dealt(semantic), "node")
    lost = F.col("reason").isNotNull() & ~F.coalesce("kept", F.lit(False))
    state = cut_lineage(state.withColumn("automation", F.when(lost, risky).otherwise(F.col("automation"))))
    unsafe = (F.col("status") == sound) & ((F.col("resolution") != exact) | (F.col("automation") != automatic))
    firm = state.where(F.col("status") == sound).select(F.col("node").alias("dst"))
    through = edges.join(_dealt(firm), "dst", "left_semi")
    through = cut_lineage(through.select("src", "dst"))
    seeds = state.where(unsafe).select("node")
    first = through.join(_dealt(seeds.withColumnRenamed("node", "dst")), "dst").select(F.col("src").alias("node"))
    above = _spread(_turned(through), first)
    marked = state.join(_dealt(above.select("node", F.lit(True).alias("__hit"))), "node", "left")
    pushed = (F.col("automation") == automatic) & F.col("__hit").isNotNull()
    reasons = F.array_compact(F.array("reason", F.when(pushed, AUTOMATION_RISK)))
    return marked.select(
        "node", "status", "resolution", F.when(pushed, risky).otherwise(F.col("automation")).alias("automation"), reasons.alias("reasons")
    )


def dependency_risks(states: DataFrame, edges: DataFrame, sound: str, exact: str, automatic: str) -> DataFrame:
    """``(node, dependency, risk)``: every direct dependency that is a risk, by
    the states of ``propagate_risks``; one row each, so no list outgrows a row."""
    edges = edges.select("src", "dst").distinct().join(_dealt(states.select(F.col("node").alias("src"))), "src", "left_semi")
    below = edges.join(_dealt(states.withColumnRenamed("node", "dst")), "dst", "left")
    unsafe = (F.col("resolution") != exact) | (F.col("automation") != automatic)
    risk = (
        F.when(F.col("status").isNull(), UNRESOLVED)
        .when(F.col("status") != sound, F.col("status"))
        .when(unsafe, F.concat_ws(":", "resolution", "automation"))
    )
    found = below.select(F.col("src").alias("node"), F.col("dst").alias("dependency"), risk.alias("risk"))
    return found.where("risk IS NOT NULL")
