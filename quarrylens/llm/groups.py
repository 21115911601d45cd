"""Consolidating pairwise matches into groups.

Deterministic Borůvka hooking: every component selects its smallest outgoing edge, the trees that arise collapse by
pointer doubling, edges are relabelled with the roots and deduplicated, until no edge is left. A round at least halves
the components that still have edges, so rounds grow with the logarithm of the largest group, whatever its shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.session import cut, release

#: A link counts from this similarity on.
LINKED = 0.85


def entity_id(entity: str) -> Column:
    """``file::name::line`` with the path in POSIX form; null unless all three are given."""
    raw = F.col(f"{entity}.file")
    clean = F.regexp_replace(F.regexp_replace(F.translate(raw, "\\", "/"), "/+", "/"), r"^(?:\./)+", "")
    # most paths are clean already, and looking costs less than rewriting
    path = F.when(raw.contains("\\") | raw.contains("//") | raw.startswith("./"), clean).otherwise(raw)
    line = F.col(f"{entity}.line").cast("bigint").cast("string")
    return F.when(F.col(f"{entity}.name").isNotNull() & path.isNotNull() & line.isNotNull(), F.concat(path, F.lit("::"), F.col(f"{entity}.name"), F.lit("::"), line))


def unit_similarity(value: Column) -> Column:
    """A similarity in 0..1; values above 1 are percentages; null for NaN, negative and impossible ones."""
    share = F.when(value > 1, value / 100.0).otherwise(value)
    return F.when(F.isnan(value) | (value < 0) | (share > 1), None).otherwise(share)


def component_roots(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of ``edges(lo, hi)``, pairs of different long ids; ``root`` names the component.

    Every loop state is written to the shared checkpoint folder: a lost executor costs one step, not the loop. Only
    emptiness is asked on the driver. Edges at a hub share a key; the minimum is taken before the shuffle, and the
    adaptive planner splits the hub's partition in the relabelling joins, whose other side has one row per component.
    """
    edges = cut(edges.select("lo", "hi").distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        # a component's smallest edge, ordered by (lower end, upper end), leads to its smallest neighbour
        ends = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("id"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("id"), F.col("lo").alias("to")))).alias("e")).select("e.*")
        hook = ends.groupBy("id").agg(F.min("to").alias("to"))
        # the only cycles are two components that chose the same edge: the smaller one is the root
        back = hook.select(F.col("id").alias("to"), F.col("to").alias("back"))
        forest = hook.join(back, "to").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("root"))
        forest = cut(forest)
        settled: DataFrame | None = None
        while True:
            # who points at a root is done; only the others jump on, over everybody's pointers
            every = forest if settled is None else forest.unionByName(settled)
            up = every.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = cut(forest.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            done = jumped.where("not moved").drop("moved")
            settled = done if settled is None else settled.unionByName(done)
            forest = jumped.where("moved").drop("moved")
            if forest.isEmpty():
                break
        levels.append(settled)
        low, high = settled.toDF("lo", "low"), settled.toDF("hi", "high")
        renamed = edges.join(low, "lo").join(high, "hi").where("low <> high")
        before, edges = edges, cut(renamed.select(F.least("low", "high").alias("lo"), F.greatest("low", "high").alias("hi")).distinct())
        release(before)
    if not levels:
        return edges.select(F.col("lo").alias("id"), F.col("hi").alias("root"))
    # compose the levels from the last, the smallest, to the first
    total = levels[-1]
    for level in reversed(levels[:-1]):
        above = total.toDF("root", "top")
        total = level.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return total


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``(node_id, id)`` with a long per node, and the seed that makes the longs different for different nodes.

    Hashes need no join to number the links' ends; should two nodes share one, the next seed is taken.
    """
    seed = 0
    while True:
        out = nodes.select("node_id", F.xxhash64("node_id", F.lit(seed)).alias("id"))
        total, different = out.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        if total == different:
            return out, seed
        seed += 1


def group_ids(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, group_id)`` of all ``nodes(node_id)``, given ``links(a, b)``; the smallest id of a group names it.

    Nodes without a link are their own group; null nodes, links with a null end and loops are ignored; repeated links
    count once; ends of links are nodes whether named or not. Strings are replaced by longs for the loop, so that it moves
    16 bytes an edge, and only nodes with a link take part.
    """
    links = links.where("a is not null and b is not null and a <> b")
    every = cut(nodes.where("node_id is not null").select("node_id").unionByName(links.select(F.explode(F.array("a", "b")).alias("node_id"))).distinct())
    known, seed = numbered(every)
    x, y = (F.xxhash64(c, F.lit(seed)) for c in ("a", "b"))
    roots = cut(component_roots(links.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))))
    rooted = known.join(roots, "id", "left").select("node_id", F.coalesce("root", "id").alias("root"))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    names = linked.groupBy("root").agg(F.min("node_id").alias("group_id"))
    return rooted.join(names, "root", "left").select("node_id", F.coalesce("group_id", "node_id").alias("group_id"))


def clone_groups(pairs: DataFrame, linked: float = LINKED) -> DataFrame:
    """``(node_id, group_id)`` of every entity named in a table of clone pairs; the table is read once."""
    rows = pairs.select(entity_id("entity1").alias("a"), entity_id("entity2").alias("b"), (unit_similarity(F.col("similarity").cast("double")) >= linked).alias("linked"))
    rows = cut(rows)
    return group_ids(rows.where("linked").select("a", "b"), rows.select(F.explode(F.array("a", "b")).alias("node_id")))
