"""Reference resolution and graph analytics on ``edges(src, dst, weight)``.

Loops write their state to the shared checkpoint folder after each step and ask the driver only for a count or a sum.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import risk, risk_category
from quarrylens.session import cut, release

#: Weight of a reference by kind; method names too common to resolve without their receiver.
EDGE_WEIGHTS = {"inherit": 3.0, "call": 1.5, "usage": 1.0, "type": 1.0, "import": 0.5}
AMBIGUOUS = [
    "get", "set", "put", "add", "remove", "pop", "push", "clear", "append", "extend", "insert", "update", "keys", "values", "items", "__init__", "__new__", "__del__", "__enter__", "__exit__", "read", "write",
    "close", "open", "flush", "seek", "send", "receive", "connect", "disconnect", "start", "stop", "run", "execute", "call", "load", "save", "dump", "parse", "name", "value", "data", "result", "status",
    "type", "id", "render",
]


def innermost_scope(points: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Each of ``points(file, line, ...)`` with the smallest of ``scopes(file, first, last, node)`` around it; others are dropped."""
    held = points.join(scopes, "file").where("line between first and last")
    order = Window.partitionBy(*keys).orderBy(F.col("last") - F.col("first"), "first", "node")
    return held.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "first", "last")


#: References and targets of a name that meet in one task; pairs beyond are spread over several.
SIDE = 4096


@dataclass(frozen=True)
class Links:
    """A graph of references by what they name: each source is linked to keys, and each key to its targets.

    ``sources(src, key, name, exact, kind, base)``: one row per reference; ``base`` is its weight before the target's factor.
    ``targets(key, dst, factor, copies, own)``: ``own`` is the target's qualified key with its factor. A name shared by
    many costs its sources plus its targets, not their product. ``mixed``: some node has several names, so that a pair may
    come from several keys.
    """

    sources: DataFrame
    targets: DataFrame
    mixed: bool

    def summed(self) -> DataFrame:
        """``(src, key, name, exact, base, kinds)``, one row per source and key that has another target."""
        alone = self.targets.select(F.col("dst").alias("src"), "key", F.lit(True).alias("self"))
        others = self.targets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        rows = self.sources.groupBy("src", "key", "name", "exact").agg(F.sum("base").alias("base"), F.collect_set("kind").alias("kinds"))
        rows = rows.join(others, "key").join(alone, ["src", "key"], "left").withColumn("self", F.coalesce("self", F.lit(False)))
        return rows.where(F.col("n") > F.col("self").cast("int"))

    def disjoint(self) -> DataFrame:
        """``summed`` with targets of one source met once: exact keys go into ``more`` of the plain name, if that is linked too."""
        own = F.struct(F.col("key").alias("k"), F.struct("base", "kinds").alias("v"))
        rows = self.summed().groupBy("src", "name").agg(
            F.collect_list(F.when(~F.col("exact"), F.struct("key", "n", "self", "base", "kinds"))).alias("wide"), F.collect_list(F.when(F.col("exact"), F.struct("key", "n", "self", "base", "kinds"))).alias("narrow"), F.map_from_entries(F.collect_list(F.when(F.col("exact"), own))).alias("more")
        )
        rows = rows.select("src", F.explode(F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("narrow"))).alias("e"), F.when((F.size("wide") > 0) & (F.size("narrow") > 0), F.col("more")).alias("more"))
        return rows.select("src", "e.*", "more")

    def reached(self, rows: DataFrame) -> DataFrame:
        """``(node)``: targets that another node than themselves leads to, of ``rows(src, key)`` from ``summed``."""
        asked = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        me = rows.select(F.col("src").alias("dst"), "key", F.lit(1).alias("me"))
        return self.targets.join(asked, "key").join(me, ["key", "dst"], "left").where(F.col("c") > F.coalesce("me", F.lit(0))).select(F.col("dst").alias("node"))

    def met(self, sources: DataFrame) -> DataFrame:
        """``sources(src, key, ...)`` with all targets of their keys but themselves, at most ``SIDE`` of both sides at once."""
        sides = sources.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("across"))
        sides = cut(sides.join(self.targets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("down")), "key").where("across > 1 or down > 1"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        slot = lambda by, n: F.pmod(F.xxhash64(*by), F.coalesce(n, F.lit(1))).cast("int")
        spread = [c for c in ("src", "kind", "ref") if c in sources.columns]
        left = sources.join(sides, "key", "left").withColumn("x", slot(spread, F.col("across"))).withColumn("y", every(F.col("down"))).drop("across", "down")
        right = self.targets.join(sides, "key", "left").withColumn("y", slot(["dst"], F.col("down"))).withColumn("x", every(F.col("across"))).drop("across", "down")
        return left.join(right, ["key", "x", "y"]).where("src <> dst").drop("x", "y")


def links(references: DataFrame, entities: DataFrame) -> Links:
    """References by the keys they lead to, as ``resolve`` defines them; no pair of source and target is formed."""
    goal = cut(entities.select(F.col("node").alias("dst"), "name", "qualified", "utility", "test", "file", "first", "last"))
    keyed = references.select("file", "line", "target", "kind", "receiver").withColumn("ref", F.monotonically_increasing_id())
    factor = F.when(F.col("utility"), 0.1).otherwise(1.0) * F.when(F.col("test"), 0.3).otherwise(1.0)
    named, full = F.concat(F.lit("~"), "name"), F.concat(F.lit("="), "qualified")
    # an entity stands under its name and under its qualified name
    stands = goal.select("dst", factor.alias("factor"), full.alias("own"), F.explode(F.array(named, full)).alias("key")).where("key is not null")
    targets = stands.groupBy("key", "dst", "own").agg(F.sum("factor").alias("factor"), F.count(F.lit(1)).alias("copies"))
    targets = targets.groupBy("key", "dst").agg(F.sum("factor").alias("factor"), F.sum("copies").alias("copies"), F.map_from_entries(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", "factor")))).alias("own"))
    targets = cut(targets)
    sizes = targets.groupBy("key").agg(F.sum("copies").alias("targets"))
    placed = innermost_scope(keyed, goal.select("file", "first", "last", F.col("dst").alias("node")), ["file", "ref"]).select(F.col("node").alias("src"), "ref", "kind", F.col("target").alias("name"), F.concat(F.lit("="), F.concat_ws(".", "receiver", "target")).alias("exact"), "receiver")
    received = F.col("receiver").isNotNull()
    placed = placed.withColumn("exact", F.when(received, F.col("exact")).otherwise(F.concat(F.lit("~"), "name")))  # no null meets anything
    placed = placed.join(sizes.select(F.col("key").alias("exact"), F.lit(True).alias("fits")), "exact", "left")
    loose, fits = F.when(~(received & F.col("name").isin(AMBIGUOUS)), F.concat(F.lit("~"), "name")), received & F.col("fits").isNotNull()
    placed = placed.select("src", "ref", "kind", "name", fits.alias("exact"), F.when(fits, F.col("exact")).otherwise(loose).alias("key"))
    table = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(1.0)) / F.sqrt("targets")
    sources = cut(placed.where("key is not null").join(sizes, "key").select("src", "key", "name", "exact", "kind", "ref", base.alias("base")))
    several = goal.groupBy("dst").agg(F.countDistinct(F.coalesce("name", F.lit("")), F.coalesce("qualified", F.lit(""))).alias("n")).where("n > 1")
    return Links(sources, targets, not several.isEmpty())


def resolve(references: DataFrame, entities: DataFrame) -> DataFrame:
    """``(src, dst, kind, weight)`` of resolved references.

    ``references(file, line, target, kind, receiver)``; ``entities(node, file, first, last, name, qualified, utility,
    test)``. A reference belongs to its innermost scope; it goes to the receiver's method, else to all of that name unless
    the receiver is unknown and the name too common. A weight is divided by the root of the number of targets and lowered
    for utilities (0.1) and tests (0.3). References outside any scope and to oneself are dropped.
    """
    found = links(references, entities)
    rows = found.met(found.sources).withColumn("weight", F.col("base") * F.col("factor") / F.col("copies"))
    if not found.targets.where("copies > 1").isEmpty():  # entities of one node are so many targets
        rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("src", "dst", "kind", "weight")


def build_edges(resolved: DataFrame) -> DataFrame:
    """``(src, dst, weight, kinds)``: one row per pair."""
    return resolved.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def nodes_of(edges: DataFrame | Links) -> DataFrame:
    """``(node)``: both ends of the edges."""
    if isinstance(edges, Links):
        rows = cut(edges.summed().select("src", "key"))
        return rows.select(F.col("src").alias("node")).unionByName(edges.reached(rows)).distinct()
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def linked_edges(found: Links) -> DataFrame:
    """``build_edges`` of links. A source's references to one key are summed before they meet the targets, so pairs are
    written as they are formed, neither shuffled nor sorted."""
    if found.mixed:
        rows = found.met(found.sources)
        return build_edges(rows.select("src", "dst", "kind", (F.col("base") * F.col("factor")).alias("weight")))
    rows = found.met(cut(found.disjoint().select("src", "key", "base", "kinds", "more")))
    exact = F.try_element_at("more", F.get(F.map_keys("own"), F.lit(0)))
    weight = F.col("factor") * (F.col("base") + F.coalesce(exact["base"], F.lit(0.0)))
    kinds = F.when(exact.isNull(), F.sort_array("kinds")).otherwise(F.sort_array(F.array_union("kinds", exact["kinds"])))
    return rows.select("src", "dst", weight.alias("weight"), kinds.alias("kinds"))


def linked_degrees(found: Links) -> DataFrame:
    """``degrees`` of links, counted by key."""
    if found.mixed:
        return degrees(linked_edges(found))
    rows = cut(found.disjoint().select("src", "key", "n", "self"))
    out = rows.select(F.col("src").alias("node"), F.lit(0).cast("bigint").alias("i"), (F.col("n") - F.col("self").cast("int")).alias("o"))
    asked = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    # sources with no other target are not among the rows, so a target takes off itself only if it is
    come = found.targets.select("key", "dst").join(asked, "key").join(rows.where("self").select(F.col("src").alias("dst"), "key", F.lit(1).alias("me")), ["key", "dst"], "left")
    come = come.select(F.col("dst").alias("node"), (F.col("c") - F.coalesce("me", F.lit(0))).alias("i"), F.lit(0).cast("bigint").alias("o"))
    return out.unionByName(come).groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).where("fan_in > 0 or fan_out > 0")


def degrees(edges: DataFrame | Links) -> DataFrame:
    """``(node, fan_in, fan_out)`` over different neighbours, in one shuffle."""
    if isinstance(edges, Links):
        return linked_degrees(edges)
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hotspots(edges: DataFrame | Links, complexity: DataFrame, least_coupling: int = 10) -> DataFrame:
    """``(node, fan_in, fan_out, complexity, coupling, risk, category)`` of the nodes with that much coupling."""
    rows = degrees(edges).join(complexity, "node", "left").withColumn("complexity", F.coalesce("complexity", F.lit(1)))
    i, o, c = F.col("fan_in"), F.col("fan_out"), F.col("complexity")
    return rows.where(i + o >= least_coupling).select("node", "fan_in", "fan_out", "complexity", (i * o).alias("coupling"), F.round(risk(i, o, c), 4).alias("risk"), risk_category(i, o, c).alias("category"))


def order_statistics(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, most, and the values at n div 10 and n div 100 of the descending order.

    Counted per value before any ranking, so the single ordered pass sees different values only.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    window = Window.partitionBy(F.lit(0)).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(window))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    at = ranked.join(F.broadcast(total))

    def pick(part: int) -> Column:
        return F.max(F.when(F.col("upto") > F.floor(F.col("n") / part), F.col("v")))

    return at.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("most").alias("most"), pick(10).alias("p90"), pick(100).alias("p99"))


def neighbours_top(edges: DataFrame, k: int = 3, least: float = 0.1, utilities: DataFrame | None = None) -> DataFrame:
    """``(node, side, other, weight, rank)``: the heaviest callers and callees of each node, without ``utilities(node)`` among them."""
    both = edges.where(F.col("weight") >= least).select(
        F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit("caller").alias("side"), F.col("src").alias("other"), "weight"), F.struct(F.col("src").alias("node"), F.lit("callee").alias("side"), F.col("dst").alias("other"), "weight"))).alias("e")
    ).select("e.*")
    if utilities is not None:
        both = both.join(utilities.select(F.col("node").alias("other")), "other", "left_anti").select("node", "side", "other", "weight")
    order = Window.partitionBy("node", "side").orderBy(F.desc("weight"), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def connected_modules(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``(node, modules)``: sorted modules of a node's neighbours; ``modules(node, module)``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*").distinct()
    return ends.join(modules.toDF("other", "module"), "other").groupBy("node").agg(F.sort_array(F.collect_set("module")).alias("modules"))


def pagerank(edges: DataFrame | Links, nodes: DataFrame | None = None, teleport: DataFrame | None = None, alpha: float = 0.85, steps: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``(node, rank)`` of weighted PageRank; ranks of nodes without successors go to the teleport vector.

    ``teleport(node, weight)`` personalises. Stops when the ranks move less than ``tolerance`` a node in sum; ``None``
    takes exactly ``steps`` steps. Edges are normalised once; a step shuffles them by source and the sums by target. Of
    links, a step shuffles sources and targets of the keys and forms no edge.
    """
    if isinstance(edges, Links):
        every, leads, come_of = _linked_flow(edges)
    else:
        every = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        sums = edges.groupBy("src").agg(F.sum("weight").alias("total"))
        flow = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(sums, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
        leads = flow.select(F.col("src").alias("node"))

        def come_of(ranks: DataFrame) -> DataFrame:
            return flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("come"))

    every = (nodes.select("node") if nodes is not None else every).distinct()
    if teleport is None:
        vector = every.withColumn("t", F.lit(1.0))
    else:
        vector = every.join(teleport.select("node", F.col("weight").alias("t")), "node", "left").fillna(0.0, ["t"])
    vector = cut(vector.join(leads.distinct().withColumn("leads", F.lit(True)), "node", "left").fillna(False, ["leads"]))
    count, mass = vector.agg(F.count(F.lit(1)), F.sum("t")).first()
    if not count:
        return vector.select("node", F.col("t").alias("rank"))
    vector = vector.withColumn("t", F.col("t") / (mass or 1.0))
    ranks = vector.select("node", "leads", "t", F.lit(1.0 / count).alias("rank"))
    dangling = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("rank"))), F.lit(0.0))
    lost, state = ranks.agg(dangling).first()[0], None
    for _ in range(steps):
        fresh = ranks.withColumnRenamed("rank", "old").join(come_of(ranks), "node", "left")
        fresh = fresh.withColumn("rank", alpha * F.coalesce("come", F.lit(0.0)) + (alpha * lost + 1 - alpha) * F.col("t"))
        before, state = state, cut(fresh.select("node", "leads", "t", "rank", "old"))
        # one aggregate tells both what the next step needs and whether there is one
        lost, moved = state.agg(dangling, F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        release(before)
        ranks = state.drop("old")
        if tolerance is not None and moved < count * tolerance:
            break
    return ranks.select("node", "rank")


def _linked_flow(found: Links):  # noqa: ANN202
    """Of links: the nodes of their edges, those that lead on, and the function from ranks to what comes in along the edges."""
    rows = found.summed().join(found.targets.groupBy("key").agg(F.sum("factor").alias("all")), "key")
    rows = rows.join(found.targets.select(F.col("dst").alias("src"), "key", F.col("factor").alias("mine")), ["src", "key"], "left")
    rows = cut(rows.select("src", "key", "base", F.coalesce("mine", F.lit(0.0)).alias("mine"), (F.col("all") - F.coalesce("mine", F.lit(0.0))).alias("rest")))
    sums = rows.groupBy("src").agg(F.sum(F.col("base") * F.col("rest")).alias("total"), F.sum(F.col("base") * F.col("mine")).alias("own"))
    flow = cut(rows.join(sums.select("src", "total"), "src").select("src", "key", (F.col("base") / F.col("total")).alias("p")))
    self = cut(sums.where("own > 0").select(F.col("src").alias("node"), (F.col("own") / F.col("total")).alias("back")))
    goals = cut(found.targets.join(rows.select("key").distinct(), "key", "left_semi").select("key", "dst", "factor"))
    leads = rows.select(F.col("src").alias("node"))

    def come_of(ranks: DataFrame) -> DataFrame:
        through = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("key").agg(F.sum(F.col("p") * F.col("rank")).alias("m"))
        come = goals.join(through, "key").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("m") * F.col("factor")).alias("come"))
        own = self.join(ranks.select("node", "rank"), "node").select("node", (F.col("back") * F.col("rank")).alias("own"))
        # a node's references to its own name lead to the others only
        return come.join(own, "node", "left").select("node", F.greatest(F.lit(0.0), F.col("come") - F.coalesce("own", F.lit(0.0))).alias("come"))

    return leads.unionByName(found.reached(rows.select("src", "key"))), leads, come_of


def weighted_indegree(edges: DataFrame) -> DataFrame:
    """``(node, rank)``: a node's share of all incoming weight, what stands in for ranks that don't converge."""
    total = edges.agg(F.sum("weight").alias("all"))
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("w")).join(F.broadcast(total)).select("node", (F.col("w") / F.col("all")).alias("rank"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def closure(edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``(src, dst, depth)``: all reachable pairs with their least number of steps; a node on a cycle reaches itself."""
    base = cut(edges.select("src", "dst").distinct())
    fresh = cut(base.withColumn("depth", F.lit(1)))
    parts, depth = [fresh], 1
    while most_steps is None or depth < most_steps:
        depth += 1
        known = reduce(DataFrame.unionByName, parts)
        step = fresh.select("src", F.col("dst").alias("mid")).join(base.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        fresh = cut(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if len(parts) >= 8:  # what is known is rewritten every few steps, not in each
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


#: Edges that one task finishes alone, some 400 MB; more edges go on in rounds of joins, with the same result.
ALONE = 6_000_000


def numbered_ends(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, a, b)``: the sorted ids of all ``(src, dst)`` of one partition, and the edges' ends as places among them."""
    ends = [[batch.column(c).to_numpy() for c in ("src", "dst")] for batch in batches]
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    src, dst = (np.concatenate([x[i] for x in ends]) for i in (0, 1))
    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    return ids, at[: len(src)], at[len(src) :]


def adjacent(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first, flat)``: what node ``i`` of ``n`` leads to is ``flat[first[i]:first[i + 1]]``."""
    return np.concatenate(([0], np.bincount(a, minlength=n).cumsum())), b[np.argsort(a, kind="stable")]


def next_to(nodes: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """What ``nodes`` lead to, once for each edge."""
    sizes = first[nodes + 1] - first[nodes]
    ends = sizes.cumsum()
    return flat[np.repeat(first[nodes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def strongly(first: list[int], flat: list[int]) -> list[int]:
    """The number of each node's strong component, in one depth-first pass."""
    n = len(first) - 1
    number, low, group, at = [0] * n, [0] * n, [-1] * n, first[:-1]
    held: list[int] = []
    count = groups = 0
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        while path:
            node = path[-1]
            if not number[node]:
                count += 1
                number[node] = low[node] = count
                held.append(node)
            if at[node] < first[node + 1]:
                x = flat[at[node]]
                at[node] += 1
                if not number[x]:
                    path.append(x)
                elif group[x] < 0:
                    low[node] = min(low[node], number[x])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[node])
            if low[node] == number[node]:
                while group[node] < 0:
                    group[held.pop()] = groups
                groups += 1
    return group


def components_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, colour)`` of the strong components of all edges of one partition; nodes without a way in or out are left out."""
    ids, a, b = numbered_ends(batches)
    n = len(ids)
    ahead, back = adjacent(a, b, n), adjacent(b, a, n)
    out, come, stays = np.diff(ahead[0]), np.diff(back[0]), np.ones(n, bool)
    gone = np.flatnonzero((out == 0) | (come == 0))
    while len(gone):
        stays[gone] = False
        before, after = next_to(gone, *back), next_to(gone, *ahead)
        np.subtract.at(out, before, 1)
        np.subtract.at(come, after, 1)
        near = np.unique(np.concatenate((before, after)))
        gone = near[stays[near] & ((out[near] <= 0) | (come[near] <= 0))]
    inside = stays[a] & stays[b]
    kept, at = np.flatnonzero(stays), stays.cumsum() - 1
    if not len(kept):
        return
    group = np.array(strongly(*(x.tolist() for x in adjacent(at[a[inside]], at[b[inside]], len(kept)))), np.int64)
    least = np.full(len(kept), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[kept])
    yield pa.RecordBatch.from_pydict({"node": pa.array(ids[kept]), "colour": pa.array(least[group])})


def numbered(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, id)``, each node once, and different ``(src, dst)`` by ids."""
    names = cut(nodes.select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    pairs = edges.select(F.col("src").alias("node"), "dst").join(names, "node").select(F.col("dst").alias("node"), F.col("id").alias("src"))
    return names, cut(pairs.join(names, "node").select("src", F.col("id").alias("dst")).distinct())


def strong_components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """``(node, component)`` of every node that can lie on a cycle; a component is named by its smallest node.

    Names are numbered first. Nodes without a way in or out are trimmed. The rest take the smallest number that reaches
    them; what leads back to it, among the nodes that took it, is its component. What remains goes on, or is finished by
    one task once it has ``alone`` edges at most. States are pairs of numbers, whatever the component's size.
    """
    if dict(edges.dtypes)["src"] == "string":
        names, pairs = numbered(edges, nodes_of(edges))
        found = strong_components(pairs, alone).join(names.toDF("name", "node"), "node").select("name", "component")
        found = cut(found)
        return found.join(found.groupBy("component").agg(F.min("name").alias("least")), "component").select(F.col("name").alias("node"), F.col("least").alias("component"))
    left = edges.where("src <> dst").select("src", "dst").distinct()
    if left.limit(alone + 1).count() <= alone:
        found = cut(left.repartition(1).mapInArrow(components_alone, "node bigint, colour bigint"))
        return found.select("node", F.col("colour").alias("component"))
    left = cut(left)
    found: list[DataFrame] = []
    while True:
        starts, ends = left.select("src").distinct(), left.select("dst").distinct()
        trimmed = cut(left.join(ends.toDF("src"), "src", "left_semi").join(starts.toDF("dst"), "dst", "left_semi"))
        size = trimmed.limit(alone + 1).count()
        if not size:
            break
        if size <= alone:
            found.append(cut(trimmed.repartition(1).mapInArrow(components_alone, "node bigint, colour bigint")))
            break
        colours = cut(trimmed.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            come = trimmed.join(colours.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            fresh = colours.join(come, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved"))
            before, fresh = colours, cut(fresh)
            colours = fresh.drop("moved")
            release(before)
            if fresh.where("moved").isEmpty():
                break
        inside = cut(trimmed.join(colours.toDF("src", "colour"), "src").join(colours.toDF("dst", "c"), "dst").where("colour = c").select("src", "dst"))
        seen = front = cut(colours.where("node = colour"))
        while True:
            step = inside.join(front.toDF("dst", "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            front = cut(step.join(seen, "node", "left_anti"))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        found.append(seen)
        gone = seen.select("node")
        left = cut(trimmed.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
        if left.isEmpty():
            break
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("node", F.col("colour").alias("component"))


@dataclass(frozen=True)
class Condensed:
    """A graph by its strong components, which are numbers: ``members(node, id, component)``, ``pairs(src, dst)`` of ids, different
    ones, ``sizes(component, size, cyclic)``, ``links(src, dst)`` between different components, and ``reach(src, dst)``, what follows from them; its pairs may be as many as the square."""

    members: DataFrame
    pairs: DataFrame
    sizes: DataFrame
    links: DataFrame

    @cached_property
    def reach(self) -> DataFrame:
        return closure(self.links).select("src", "dst")


def condense(edges: DataFrame, nodes: DataFrame) -> Condensed:
    """Reachability on components: a component reaches itself as a whole, so the closure runs on what has no cycles.

    A graph that is one strong component costs one row here and its number of nodes squared as plain pairs.
    """
    names, pairs = numbered(edges, nodes)
    components = strong_components(pairs).toDF("id", "component")
    members = cut(names.join(components, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component")))
    loops = pairs.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(loops, "component", "left")
    sizes = cut(sizes.select("component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))
    a, b = (members.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in ("src", "dst"))
    links = pairs.join(a, "src").join(b, "dst").where("csrc <> cdst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct()
    return Condensed(members, pairs, sizes, cut(links))


#: Targets whose ways in are sought at once, and links of a graph that a task holds; larger graphs go on by their pairs.
BLOCK, HELD = 4096, 6_000_000
_PACKED = "component bigint, at int, part bigint, above boolean, below boolean, first binary, flat binary, sides binary"


def packed_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of all components of one partition's links, each after all it leads to, then one row ``(first, flat, sides)``.

    In each connected ``part`` the component with most links is its hub: all ``above`` it reach all ``below`` it, both with
    itself. The last row holds the other links only: what leads to the component at ``i`` is ``flat[first[i]:first[i + 1]]``;
    ``sides[i]`` is 1 above a hub and 2 below.
    """
    ids, a, b = numbered_ends(batches)
    n = len(ids)
    if not n:
        return
    ahead, back = adjacent(a, b, n), adjacent(b, a, n)
    left, order = np.diff(ahead[0]), []
    some = np.flatnonzero(left == 0)
    while len(some):
        order.append(some)
        before = next_to(some, *back)
        np.subtract.at(left, before, 1)
        some = np.unique(before[left[before] == 0])
    order = np.concatenate([*order, np.empty(0, np.int64)])
    if len(order) != n:
        raise ValueError("links between components hold a cycle")
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    part = np.arange(n)
    while True:
        x, y = part[a], part[b]
        if (x == y).all():
            break
        np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
        while (part != part[part]).any():
            part = part[part]
    ranked = np.lexsort(((np.diff(ahead[0]) + 1) * (np.diff(back[0]) + 1), part))
    hubs = ranked[np.append(np.diff(part[ranked]) != 0, True)]
    sides = []
    for way in (back, ahead):
        seen, front = np.zeros(n, bool), hubs
        while len(front):
            seen[front] = True
            front = next_to(front, *way)
            front = np.unique(front[~seen[front]])
        sides.append(seen)
    above, below = sides
    other = ~(above[a] & below[b])
    first, flat = adjacent(at[b[other]], at[a[other]], n)
    schema = pa.schema([("component", pa.int64()), ("at", pa.int32()), ("part", pa.int64()), ("above", pa.bool_()), ("below", pa.bool_()), ("first", pa.binary()), ("flat", pa.binary()), ("sides", pa.binary())])
    columns = [ids, at.astype(np.int32), part, above, below]
    for i in range(0, n, 100_000):
        rows = [pa.array(x[i : i + 100_000]) for x in columns]
        yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(len(rows[0]), pa.binary())] * 3], schema=schema)
    packed = [first.astype(np.int32).tobytes(), flat.astype(np.int32).tobytes(), (above + 2 * below)[order].astype(np.uint8).tobytes()]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, x.type) for x in schema][:5], *[pa.array([x], pa.binary()) for x in packed]], schema=schema)


def packed_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row ``(names, groups, places, counts)`` of all ``(at, group, c)`` of one partition, by group and place."""
    number: dict[str, int] = {}
    parts = []
    for batch in batches:
        names = batch.column("group").dictionary_encode()
        known = np.array([number.setdefault(x, len(number)) for x in names.dictionary.to_pylist()], np.int32)
        parts.append((known[names.indices.to_numpy()], batch.column("at").to_numpy(), batch.column("c").to_numpy()))
    if not sum(len(x[0]) for x in parts):
        return
    groups, places, counts = (np.concatenate([x[i] for x in parts]) for i in range(3))
    by = np.lexsort((places, groups))
    packed = {"groups": groups[by].astype(np.int32), "places": places[by].astype(np.int32), "counts": counts[by].astype(np.int64)}
    yield pa.RecordBatch.from_pydict({"names": pa.array([list(number)], pa.list_(pa.string())), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in packed.items()}})


def reach_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(group, pairs)`` of rows of one graph, what is held and ``task``, one of ``tasks``: the weights of the task's targets
    times those of the sources that reach them, but from above a hub to below it.

    By bits: a component's are its own and those of what it leads to; from a block's targets up, only what has some is visited.
    """
    for batch in batches:
        for row in batch.to_pylist():
            first, flat, groups, places = (array("i", row[c]) for c in ("first", "flat", "groups", "places"))
            sides, counts, names = row["sides"], array("q", row["counts"]), row["names"]
            holds, holders = (array("i", x.astype(np.int32).tobytes()) for x in adjacent(np.frombuffer(row["places"], np.int32), np.arange(len(places)), len(sides)))
            sums: dict[int, int] = {}
            for start in range(row["task"] * row["size"], len(places), row["tasks"] * row["size"]):
                bits: dict[int, int] = {}
                own: dict[int, int] = {}
                masks: dict[int, dict[int, int]] = {}  # by group and weight
                lower = 0
                for i in range(start, min(start + row["size"], len(places))):
                    at, bit = places[i], 1 << i - start
                    if sides[at] & 2:
                        lower |= bit
                    if first[at] < first[at + 1]:
                        own[at] = own.get(at, 0) | bit
                    of = masks.setdefault(groups[i], {})
                    of[counts[i]] = of.get(counts[i], 0) | bit
                todo = sorted(own)
                while todo:
                    node = heappop(todo)
                    seen = bits.pop(node, 0)
                    if seen:
                        for i in holders[holds[node] : holds[node + 1]]:
                            if groups[i] in masks:
                                sums[groups[i]] = sums.get(groups[i], 0) + counts[i] * sum(w * (seen & mask).bit_count() for w, mask in masks[groups[i]].items())
                    seen |= own.pop(node, 0)
                    high = seen & ~lower
                    for x in flat[first[node] : first[node + 1]]:
                        come = high if sides[x] & 1 else seen
                        if come:
                            if x not in bits and x not in own:
                                heappush(todo, x)
                            bits[x] = bits.get(x, 0) | come
            yield pa.RecordBatch.from_pydict({"group": pa.array([names[g] for g in sums], pa.string()), "pairs": pa.array(list(sums.values()), pa.int64())})


def reach_sums(links: DataFrame, held: DataFrame) -> DataFrame:
    """``(group, pairs)``: over all pairs of different components of which one reaches the other, what both hold of a group,
    multiplied; ``held(component, group, c)``.

    The pairs themselves are never formed: those across a hub are a product of two sums, for the others ``BLOCK`` targets
    at a time are bits that pass along the links.
    """
    if links.limit(HELD + 1).count() > HELD:
        a, b = held.toDF("src", "group", "ca"), held.toDF("dst", "group", "cb")
        return closure(links).join(a, "src").join(b, ["dst", "group"]).groupBy("group").agg(F.sum(F.col("ca") * F.col("cb")).alias("pairs"))
    spark = links.sparkSession
    packed = cut(links.select("src", "dst").repartition(1).mapInArrow(packed_graph, _PACKED))
    places = packed.where("component is not null")
    rows = cut(held.where("group is not null").join(places, "component").select("group", "at", "part", "above", "below", F.col("c").cast("bigint").alias("c")))
    across = lambda held, by: F.coalesce(F.sum(F.when(by, held)), F.lit(0))
    c, above, below = F.col("c"), F.col("above"), F.col("below")
    through = rows.where(above | below).groupBy("part", "group").agg((across(c, above) * across(c, below) - across(c * c, above & below)).alias("pairs"))
    weights = cut(rows.select("at", "group", "c").repartition(1).mapInArrow(packed_held, "names array<string>, groups binary, places binary, counts binary"))
    nodes, total = places.count(), rows.count()
    size = max(1, min(BLOCK, 1_000_000_000 // max(1, nodes)))  # some 125 MB of bits in a task
    tasks = max(1, min(-(-total // size), 4 * spark.sparkContext.defaultParallelism))
    graph = packed.where("component is null").select("first", "flat", "sides").crossJoin(weights)
    wide = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task"), F.lit(tasks).alias("tasks"), F.lit(size).alias("size")).crossJoin(F.broadcast(graph))
    found = wide.mapInArrow(reach_in_blocks, "group string, pairs bigint").unionByName(through.select("group", "pairs"))
    return found.groupBy("group").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def propagation(edges: DataFrame, nodes: DataFrame, graph: Condensed | None) -> DataFrame:
    """One row ``(nodes, edges, reachable, cost, status)``; cost = reachable pairs / n (n - 1), null below two nodes.

    A node on a cycle reaches itself. Without a condensed graph the edges alone count: a lower bound, without a verdict.
    """
    n = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("nodes"))
    m = (graph.pairs if graph else edges.select("src", "dst").distinct()).agg(F.count(F.lit(1)).alias("edges"))
    if graph is None:
        out = n.join(F.broadcast(m)).withColumn("reachable", F.col("edges"))
    else:
        inside = graph.sizes.where("cyclic").agg(F.coalesce(F.sum(F.col("size") * F.col("size")), F.lit(0)).alias("inside"))
        across = reach_sums(graph.links, graph.sizes.select("component", F.lit("").alias("group"), F.col("size").alias("c")))
        across = across.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("across"))
        out = n.join(F.broadcast(m)).join(F.broadcast(inside)).join(F.broadcast(across)).select("nodes", "edges", (F.col("inside") + F.col("across")).alias("reachable"))
    cost = F.when(F.col("nodes") > 1, F.col("reachable") / (F.col("nodes") * (F.col("nodes") - 1)).cast("double"))
    status = F.when(F.col("cost").isNull(), "N/A").when(F.lit(graph is None), "APPROXIMATE").when(F.col("cost") <= 0.10, "PASS").when(F.col("cost") <= 0.43, "WARNING").otherwise("CRITICAL")
    return out.withColumn("cost", cost).withColumn("status", status)


def descendants(graph: Condensed) -> DataFrame:
    """``(node, descendants)`` without the node itself, of the nodes that have some."""
    size = graph.sizes.select(F.col("component").alias("dst"), "size")
    below = graph.reach.join(size, "dst").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("below"))
    per = graph.sizes.join(below, "component", "left").select("component", (F.col("size") - 1 + F.coalesce("below", F.lit(0))).alias("descendants"))
    return graph.members.join(per.where("descendants > 0"), "component").select("node", "descendants")


def module_coupling(edges: DataFrame, modules: DataFrame, graph: Condensed) -> DataFrame:
    """``(module, nodes, internal, external)``: density of reachability inside and edges with one end outside."""
    size = modules.groupBy("module").agg(F.count(F.lit(1)).alias("nodes"))
    placed = cut(graph.members.join(modules, "node").select("id", "component", "module"))
    held = placed.groupBy("component", "module").agg(F.count(F.lit(1)).alias("c"))
    inside = held.join(graph.sizes.where("cyclic"), "component").select("module", (F.col("c") * F.col("c")).alias("pairs"))
    across = reach_sums(graph.links, held.toDF("component", "group", "c")).select(F.col("group").alias("module"), "pairs")
    inside = inside.unionByName(across).groupBy("module").agg(F.sum("pairs").alias("pairs"))
    x, y = (placed.select(F.col("id").alias(end), F.col("module").alias(m)) for end, m in (("src", "ma"), ("dst", "mb")))
    cross = graph.pairs.join(x, "src").join(y, "dst").where("ma <> mb")
    outside = cross.select(F.explode(F.array("ma", "mb")).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("external"))
    out = size.join(inside, "module", "left").join(outside, "module", "left").fillna(0, ["pairs", "external"])
    internal = F.when(F.col("nodes") == 1, 1.0).otherwise(F.col("pairs") / (F.col("nodes") * (F.col("nodes") - 1)))
    return out.select("module", "nodes", internal.alias("internal"), "external")


def cycles(edges: DataFrame) -> DataFrame:
    """``(node, cycle)``: nodes on a cycle with the smallest node of their strongly connected component."""
    found = strong_components(edges)
    larger = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
    on = found.join(larger, "component").select("node", F.col("component").alias("cycle"))
    return on.unionByName(loops.join(on, "node", "left_anti"))


def upstream(edges: DataFrame, start: str, most_depth: int = 5, importance: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``(node, depth)``: who reaches ``start`` and in how many steps; unimportant nodes are hidden but passed through."""
    spark = edges.sparkSession
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")).distinct())
    seen = front = cut(spark.createDataFrame([(start, 0)], "node string, depth int"))
    for depth in range(1, most_depth + 1):
        step = front.select("node").join(back, "node").select(F.col("caller").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    out = seen.where("depth > 0")
    if importance is not None:
        out = out.join(importance.select("node", "rank"), "node", "left").where(F.coalesce("rank", F.lit(0.0)) >= least).drop("rank")
    return out


def simple_paths(edges: DataFrame, start: str | DataFrame, end: str | None = None, most_depth: int = 5, least: float = 0.1) -> DataFrame:
    """``(path, depth)``: paths without repeated nodes from ``start`` (a node or ``(node)``), to ``end`` or to anywhere.

    For the ways into a node, give the reversed edges. How many paths there are is up to the graph: nothing is cut but by
    ``most_depth`` and ``least``.
    """
    spark = edges.sparkSession
    out = cut(edges.where(F.col("weight") >= least).select("src", "dst").distinct())
    starts = spark.createDataFrame([(start,)], "node string") if isinstance(start, str) else start.select("node")
    front = starts.select(F.array("node").alias("path"), F.col("node").alias("src"))
    found = None
    for depth in range(1, most_depth + 1):
        step = front.join(out, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        step = cut(step)
        hits = step.where(F.col("src") == end) if end is not None else step
        hits = hits.select("path", F.lit(depth).alias("depth"))
        found = hits if found is None else found.unionByName(hits)
        front = step.where(F.col("src") != end) if end is not None else step
    assert found is not None
    return found


def path_statistics(paths: DataFrame) -> DataFrame:
    """``(node, paths, min_depth, critical, branches)``: nodes on three paths or more are critical."""
    steps = paths.withColumn("p", F.monotonically_increasing_id()).select("p", F.posexplode("path").alias("pos", "node"), "path")
    steps = steps.withColumn("next", F.get("path", F.col("pos") + 1))
    out = steps.groupBy("node").agg(F.count(F.lit(1)).alias("paths"), F.min("pos").alias("min_depth"), F.countDistinct("next").alias("followers"))
    return out.select("node", "paths", "min_depth", (F.col("paths") >= 3).alias("critical"), (F.col("followers") > 1).alias("branches"))


def betweenness(edges: DataFrame, nodes: DataFrame, sources: int = 200) -> DataFrame:
    """``(node, betweenness)``: shortest-path betweenness with weights as distances, from at most ``sources`` sources.

    Exact up to ``sources`` nodes, else scaled from the sources with the smallest hashes. Everything runs on rows of
    (source, node), partitioned by node: distances by relaxing what improved; the number of shortest paths and the
    dependencies as sums over the hops of the paths, which end because shortest paths hold no cycle. Weights are positive.
    """
    base = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    every = cut(nodes.select("node").distinct())
    n = every.count()
    picked = every.orderBy(F.xxhash64("node")).limit(sources) if n > sources else every
    scale = (n / max(1, min(n, sources))) / max(1, (n - 1) * (n - 2))
    front = cut(picked.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d")))
    far = front
    while True:
        step = front.join(base.withColumnRenamed("src", "node"), "node").groupBy("s", F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("weight")).alias("new"))
        better = step.join(far, ["s", "node"], "left").where("d is null or new < d").select("s", "node", F.col("new").alias("d"))
        front = cut(better)
        if front.isEmpty():
            break
        far = cut(far.join(front.select("s", "node"), ["s", "node"], "left_anti").unionByName(front))
    # edges on shortest paths
    ahead = far.select("s", F.col("node").alias("dst"), F.col("d").alias("e"))
    tree = cut(far.join(base.withColumnRenamed("src", "node"), "node").join(ahead, ["s", "dst"]).where("d + weight = e").select("s", F.col("node").alias("src"), "dst"))

    def over_hops(start: DataFrame, here: str, there: str) -> DataFrame:
        """``(s, node, x)``: the sum, over all ways along the tree's edges and all their lengths from 1, of the start's ``x``."""
        parts, now = [], start
        while True:
            now = cut(now.withColumnRenamed("node", here).join(tree, ["s", here]).groupBy("s", F.col(there).alias("node")).agg(F.sum("x").alias("x")))
            if now.isEmpty():
                break
            parts.append(now)
        out = start.limit(0)
        for part in parts:
            out = out.unionByName(part)
        return out.groupBy("s", "node").agg(F.sum("x").alias("x"))

    ways = cut(over_hops(far.where("d = 0").where("s = node").select("s", "node", F.lit(1.0).alias("x")), "src", "dst"))
    ends = ways.select("s", "node", (1 / F.col("x")).alias("x"))
    depends = over_hops(ends, "dst", "src").withColumnRenamed("x", "g")
    parts = ways.join(depends, ["s", "node"]).where("s <> node").groupBy("node").agg(F.sum(F.col("x") * F.col("g")).alias("part"))
    return every.join(parts, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def bottleneck_summary(scores: DataFrame, least: float = 0.001) -> DataFrame:
    """One row ``(analysed, above, average, most)`` of ``scores(node, betweenness)``."""
    b = F.col("betweenness")
    return scores.agg(F.count(F.lit(1)).alias("analysed"), F.count_if(b >= least).alias("above"), F.round(F.coalesce(F.avg(b), F.lit(0.0)), 6).alias("average"), F.round(F.coalesce(F.max(b), F.lit(0.0)), 6).alias("most"))


def replace_files(edges: DataFrame, files: DataFrame, fresh: DataFrame, file_of: Column) -> DataFrame:
    """Edges after a change: those that begin in changed ``files(file)`` are dropped and ``fresh`` edges added."""
    kept = edges.withColumn("file", file_of).join(files.select("file").distinct(), "file", "left_anti").drop("file")
    return kept.unionByName(fresh)
