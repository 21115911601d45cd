"""Queries of graph analytics, on entities and on repositories linked by clone pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import graph as ops
from quarrylens.plans.bindings import ENTITIES, ENTITY_EDGES, NODES, entities, entity_edges, entity_pairs, repo_edges, repo_edges_sql
from quarrylens.operators.retrieval import top
from quarrylens.session import cut, read_table

HUB, TURN = "lantern-monorepo", "2024-01-01"


def _complexity(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).groupBy("node").agg(F.max("lines").alias("complexity"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return entity_edges(spark, sf)


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return ops.degrees(entity_edges(spark, sf))


def coupling_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return ops.hotspots(entity_edges(spark, sf), _complexity(spark, sf), 3)


def hotspot_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.order_statistics(ops.hotspots(entity_edges(spark, sf), _complexity(spark, sf), 1), "risk")
    return out.select("n", F.round("mean", 4).alias("mean"), "most", "p90", "p99")


def hotspot_categories(spark: SparkSession, sf: str) -> DataFrame:
    return ops.hotspots(entity_edges(spark, sf), _complexity(spark, sf), 1).groupBy("category").agg(F.count(F.lit(1)).alias("nodes"))


def dispatchers(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.degrees(entity_edges(spark, sf)).join(_complexity(spark, sf), "node", "left")
    return rows.select("node", F.round(F.col("fan_out") * F.log1p(F.coalesce("complexity", F.lit(1)).cast("double")), 4).alias("score"))


def dependency_context(spark: SparkSession, sf: str) -> DataFrame:
    return ops.neighbours_top(entity_edges(spark, sf))


def dependency_context_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Without utilities among the neighbours."""
    utilities = entities(spark, sf).where(fx.is_utility(F.col("name"))).select("node")
    return ops.neighbours_top(entity_edges(spark, sf), utilities=utilities)


def connected_modules(spark: SparkSession, sf: str) -> DataFrame:
    modules = entities(spark, sf).select("node", fx.module_of(F.col("file")).alias("module")).distinct()
    return ops.connected_modules(entity_edges(spark, sf), modules).select("node", F.array_join("modules", ",").alias("modules"))


def weighted_indegree(spark: SparkSession, sf: str) -> DataFrame:
    return ops.weighted_indegree(repo_edges(spark, sf)).select("node", F.round("rank", 8).alias("rank"))


def _ranks(frame: DataFrame) -> DataFrame:
    return frame.select("node", F.round("rank", 8).alias("rank"))


def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(ops.pagerank(repo_edges(spark, sf), steps=10, tolerance=None))


def reverse_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(ops.pagerank(ops.reversed_edges(repo_edges(spark, sf)), steps=10, tolerance=None))


def personalised_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    edges = repo_edges(spark, sf)
    seeds = _nodes(edges).where("node like 'lantern%' or node like 'moss%'").withColumn("weight", F.lit(1.0))
    return _ranks(ops.pagerank(edges, teleport=seeds, steps=10, tolerance=None))


def converged_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Until the ranks move less than a billionth a node."""
    out = ops.pagerank(repo_edges(spark, sf), tolerance=1e-9)
    return out.select("node", F.round("rank", 6).alias("rank"))


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return ops.closure(repo_edges(spark, sf))


def propagation_cost(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(repo_edges(spark, sf))
    return ops.propagation(edges, _nodes(edges), ops.condense(edges, _nodes(edges))).withColumn("cost", F.round("cost", 8))


def entity_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Propagation cost of the graph of entities, which has many components."""
    edges = cut(entity_edges(spark, sf))
    nodes = cut(_nodes(edges))
    return ops.propagation(edges, nodes, ops.condense(edges, nodes)).withColumn("cost", F.round("cost", 10))


def propagation_bound(spark: SparkSession, sf: str) -> DataFrame:
    """The lower bound by edges alone, without a verdict."""
    edges = cut(entity_edges(spark, sf))
    return ops.propagation(edges, _nodes(edges), None).withColumn("cost", F.round("cost", 10))


def critical_nodes(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(entity_edges(spark, sf))
    return ops.descendants(ops.condense(edges, _nodes(edges)))


def critical_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five nodes that reach most others."""
    edges = cut(repo_edges(spark, sf))
    return top(ops.descendants(ops.condense(edges, _nodes(edges))), 5, [F.desc("descendants"), F.col("node")])


def _module_coupling(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(entity_edges(spark, sf))
    modules = cut(_nodes(edges).select("node", F.split_part("node", F.lit("/"), F.lit(1)).alias("module")))
    return ops.module_coupling(edges, modules, ops.condense(edges, modules))


def module_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return _module_coupling(spark, sf).withColumn("internal", F.round("internal", 8))


def module_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten modules with most nodes, and whether theirs is the largest coupling of those with more than one node."""
    rows = _module_coupling(spark, sf).withColumn("internal", F.round("internal", 8))
    most = rows.where("nodes > 1").agg(F.max("internal").alias("most"))
    return top(rows.join(F.broadcast(most)).withColumn("largest", (F.col("nodes") > 1) & (F.col("internal") == F.col("most"))).drop("most"), 10, [F.desc("nodes"), F.col("module")])


def dependency_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cycles(repo_edges(spark, sf))


def entity_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cycles(entity_edges(spark, sf))


def impact_radius(spark: SparkSession, sf: str) -> DataFrame:
    return ops.upstream(repo_edges(spark, sf), HUB, 5)


def _busiest(edges: DataFrame) -> DataFrame:
    """The ten nodes with most callees."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "node").limit(10)


def call_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of five steps at most from the ten entities with most callees."""
    edges = cut(entity_edges(spark, sf))
    return ops.simple_paths(edges, _busiest(edges)).select(F.array_join("path", ">").alias("path"), "depth")


def caller_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The other direction: paths that lead to the ten entities with most callers, read backwards."""
    edges = cut(ops.reversed_edges(entity_edges(spark, sf)))
    return ops.simple_paths(edges, _busiest(edges)).select(F.array_join(F.reverse("path"), ">").alias("path"), "depth")


def path_statistics(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(entity_edges(spark, sf))
    return ops.path_statistics(ops.simple_paths(edges, _busiest(edges)))


def bottlenecks(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(repo_edges(spark, sf))
    return ops.betweenness(edges, _nodes(edges)).where("betweenness >= 0.001").select("node", F.round("betweenness", 6).alias("betweenness"))


def bottleneck_summary(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(repo_edges(spark, sf))
    return ops.bottleneck_summary(ops.betweenness(edges, _nodes(edges)))


def hotspot_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by the tenth of the largest risk that theirs comes to, marked where they are above a threshold."""
    rows = ops.hotspots(entity_edges(spark, sf), _complexity(spark, sf), 1)
    most = rows.agg(F.max("risk").alias("most"))
    return rows.join(F.broadcast(most)).select("node", "risk", fx.decile(F.col("risk"), F.col("most")).alias("tier"), (F.col("risk") >= 10).alias("above_threshold"))


def high_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose traces need a filter: utilities, and those with more than five callers."""
    rows = ops.degrees(entity_edges(spark, sf)).join(entities(spark, sf).select("node", "name"), "node")
    reason = F.when(fx.is_utility(F.col("name")), "utility_name").when(F.col("fan_in") > 5, "high_fan_in")
    return rows.select("node", "fan_in", reason.alias("reason")).where("reason is not null")


def hotspots_top(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty riskiest hotspots of at least two callers or callees."""
    return top(ops.hotspots(entity_edges(spark, sf), _complexity(spark, sf), 2).select("node", "coupling", "risk"), 20, [F.desc("risk"), F.desc("coupling"), F.col("node")])


def incremental_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of the pairs found before a day, brought up to date with the files that have later ones."""
    clone = read_table(spark, sf, "clone").dropDuplicates(["pair_id"]).select("pair_id", (F.col("detected_at") >= F.lit(TURN).cast("timestamp")).alias("late"))
    pairs = entity_pairs(spark, sf).where("a <> b").join(clone, "pair_id").withColumn("late", F.coalesce("late", F.lit(True)))
    pairs = cut(pairs.select("a", "b", "file_a", "late"))
    touched = pairs.where("late").select(F.col("file_a").alias("file")).distinct()
    build = lambda rows: rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    fresh = build(pairs.join(touched.toDF("file_a"), "file_a", "left_semi"))
    return ops.replace_files(build(pairs.where("not late")), touched, fresh, F.split_part("src", F.lit("::"), F.lit(1)))


QUERIES = {
    f.__name__: f
    for f in (
        edge_weights, degrees, coupling_hotspots, hotspot_summary, hotspot_categories, dispatchers, dependency_context, connected_modules, weighted_indegree, pagerank, reverse_pagerank, personalised_pagerank,
        converged_pagerank, reachability, propagation_cost, critical_nodes, module_coupling, dependency_cycles, impact_radius, call_paths, path_statistics, bottlenecks, incremental_edges,
        entity_propagation, propagation_bound, critical_top, module_top, entity_cycles, caller_paths, high_connectivity, hotspots_top, dependency_context_plain, bottleneck_summary, hotspot_tiers,
    )
}

_DEGREES = ", ends as (select src as node, 0 as i, 1 as o from edges union all select dst, 1, 0 from edges), deg as (select node, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from ends group by node)"
_LINES = ", ends2 as (select a as node, lines_a as lines from pairs union all select b, lines_b from pairs), cx as (select node, max(lines) as complexity from ends2 group by node)"
_HOT = _DEGREES + _LINES + """, hot as (select node, fan_in, fan_out, coalesce(complexity, 1) as complexity, fan_in * fan_out as coupling, round((fan_in + fan_out) * ln(1 + coalesce(complexity, 1)), 4) as risk,
case when fan_in + fan_out >= 50 and coalesce(complexity, 1) >= 10 then 'Danger Zone' when fan_in + fan_out >= 50 then 'Traffic Jam' when coalesce(complexity, 1) >= 10 then 'Local Mess' else 'Low Risk' end as category from deg left join cx using (node))"""


def _pagerank_sql(edges: str, teleport: str = "1.0", steps: int = 10) -> str:
    sql = f"with {edges}{NODES}, v as (select node, t / sum(t) over () as t, node in (select src from edges) as leads from (select node, {teleport} as t from nodes)), flow as (select src, dst, weight / sum(weight) over (partition by src) as p from edges), r0 as (select node, 1.0::double / (select count(*) from nodes) as rank from nodes)"
    for k in range(1, steps + 1):
        sql += f", r{k} as materialized (select v.node, 0.85::double * coalesce(c.come, 0) + (0.85::double * (select coalesce(sum(rank), 0) from r{k - 1} join v using (node) where not leads) + 0.15::double) * t as rank from v left join (select dst as node, sum(p * rank) as come from flow join r{k - 1} on src = node group by dst) c using (node))"
    return sql + f" select node, round(rank, 8) as rank from r{steps}"


_REPOS = repo_edges_sql()
_REACH = f"with recursive {_REPOS}, reach(src, dst, depth) using key (src, dst) as (select src, dst, 1 from edges union select r.src, e.dst, min(r.depth) + 1 from reach r join edges e on r.dst = e.src left join recurring.reach q on q.src = r.src and q.dst = e.dst where q.src is null group by r.src, e.dst)"


def _closed(edges: str) -> str:
    return f"with recursive {edges}, reach(src, dst) as (select src, dst from edges union select r.src, e.dst from reach r join edges e on r.dst = e.src){NODES}"


def _cost_sql(edges: str, digits: int) -> str:
    return f"{_closed(edges)}, x as (select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from reach) as reachable) select *, round(reachable / (nodes * (nodes - 1))::double, {digits}) as cost, case when reachable / (nodes * (nodes - 1))::double <= 0.10 then 'PASS' when reachable / (nodes * (nodes - 1))::double <= 0.43 then 'WARNING' else 'CRITICAL' end as status from x"


def _paths_sql(edges: str) -> str:
    return f"with recursive {edges}, starts as (select src as node from edges group by src order by count(*) desc, src limit 10), paths(path, depth) as (select [src, dst], 1 from edges where src in (from starts) and src <> dst union all select list_append(path, dst), depth + 1 from paths join edges on src = path[-1] where depth < 5 and not list_contains(path, dst))"


_BACK = ENTITY_EDGES.replace(", edges as (", ", forward as (") + ", edges as (select dst as src, src as dst, weight from forward)"
_MODULES = f"{_closed(ENTITY_EDGES)}, m as (select node, split_part(node, '/', 1) as module from nodes), s as (select module, count(*) as nodes from m group by module), i as (select a.module, count(*) as pairs from reach join m a on a.node = src join m b on b.node = dst where a.module = b.module group by 1), x as (select unnest([a.module, b.module]) as module from edges join m a on a.node = src join m b on b.node = dst where a.module <> b.module), o as (select module, count(*) as external from x group by module), mods as (select module, nodes, round(case when nodes = 1 then 1.0 else coalesce(pairs, 0) / (nodes * (nodes - 1))::double end, 8) as internal, coalesce(external, 0) as external from s left join i using (module) left join o using (module))"

SQL = {
    "edge_weights": f"with {ENTITY_EDGES} select * from edges",
    "incremental_edges": f"with {ENTITY_EDGES} select * from edges",
    "degrees": f"with {ENTITY_EDGES}{_DEGREES} select * from deg",
    "coupling_hotspots": f"with {ENTITY_EDGES}{_HOT} select * from hot where fan_in + fan_out >= 3",
    "hotspot_summary": f"with {ENTITY_EDGES}{_HOT}, o as (select risk, row_number() over (order by risk desc) - 1 as i, count(*) over () as n from hot) select max(n) as n, round(avg(risk), 4) as mean, max(risk) as most, max(case when i = n // 10 then risk end) as p90, max(case when i = n // 100 then risk end) as p99 from o",
    "hotspot_categories": f"with {ENTITY_EDGES}{_HOT} select category, count(*) as nodes from hot group by category",
    "dispatchers": f"with {ENTITY_EDGES}{_DEGREES}{_LINES} select node, round(fan_out * ln(1 + coalesce(complexity, 1)), 4) as score from deg left join cx using (node)",
    "dependency_context": f"with {ENTITY_EDGES}, e as (select dst as node, 'caller' as side, src as other, weight from edges union all select src, 'callee', dst, weight from edges), r as (select *, cast(row_number() over (partition by node, side order by weight desc, other) as int) as rank from e) select * from r where rank <= 3",
    "connected_modules": f"with {ENTITIES}, edges as (select distinct a as src, b as dst from pairs where a <> b), m as (select distinct node as other, case when list_position(string_split(file, '/'), 'src') > 0 and len(string_split(file, '/')) > list_position(string_split(file, '/'), 'src') + 1 then string_split(file, '/')[list_position(string_split(file, '/'), 'src') + 1] else string_split(file, '/')[1] end as module from entities), n as (select src as node, dst as other from edges union select dst, src from edges) select node, string_agg(module, ',' order by module) as modules from (select distinct node, module from n join m using (other)) group by node",
    "weighted_indegree": f"with {repo_edges_sql()} select dst as node, round(sum(weight) / (select sum(weight) from edges), 8) as rank from edges group by dst",
    "pagerank": _pagerank_sql(repo_edges_sql()),
    "reverse_pagerank": _pagerank_sql(repo_edges_sql().replace(", edges as (", ", forward as (") + ", edges as (select dst as src, src as dst, weight from forward)"),
    "personalised_pagerank": _pagerank_sql(repo_edges_sql(), "case when node like 'lantern%' or node like 'moss%' then 1.0::double else 0.0::double end"),
    "reachability": f"{_REACH} select src, dst, cast(depth as int) as depth from reach",
    "propagation_cost": _cost_sql(_REPOS, 8),
    "critical_nodes": f"{_closed(ENTITY_EDGES)} select src as node, count(*) as descendants from reach where src <> dst group by src",
    "module_coupling": f"{_MODULES} select * from mods",
    "dependency_cycles": f"{_closed(_REPOS)} select a.src as node, min(a.dst) as cycle from reach a join reach b on a.src = b.dst and a.dst = b.src group by a.src",
    "impact_radius": f"with recursive {_REPOS}, b(node, depth) as (select '{HUB}', 0 union select e.src, depth + 1 from b join edges e on e.dst = b.node where depth < 5) select node, cast(min(depth) as int) as depth from b where node <> '{HUB}' group by node",
    "call_paths": f"{_paths_sql(ENTITY_EDGES)} select array_to_string(path, '>') as path, depth from paths",
    "path_statistics": f"{_paths_sql(ENTITY_EDGES)}, i as (select path, unnest(path) as node, generate_subscripts(path, 1) as k from paths) select node, count(*) as paths, cast(min(k) - 1 as int) as min_depth, count(*) >= 3 as critical, count(distinct path[k + 1]) > 1 as branches from i group by node",
    "caller_paths": f"{_paths_sql(_BACK)} select array_to_string(list_reverse(path), '>') as path, depth from paths",
    "entity_propagation": _cost_sql(ENTITY_EDGES, 10),
    "propagation_bound": f"with {ENTITY_EDGES}{NODES}, x as (select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges) select nodes, edges, edges as reachable, round(edges / (nodes * (nodes - 1))::double, 10) as cost, 'APPROXIMATE' as status from x",
    "critical_top": f"{_closed(_REPOS)}, d as (select src as node, count(*) as descendants from reach where src <> dst group by src) select *, cast(row_number() over (order by descendants desc, node) as int) as rank from d order by rank limit 5",
    "module_top": f"{_MODULES} select *, nodes > 1 and internal = (select max(internal) from mods where nodes > 1) as largest, cast(row_number() over (order by nodes desc, module) as int) as rank from mods order by rank limit 10",
    "entity_cycles": f"{_closed(ENTITY_EDGES)} select a.src as node, min(a.dst) as cycle from reach a join reach b on a.src = b.dst and a.dst = b.src group by a.src",
    "high_connectivity": f"with {ENTITIES}, edges as (select distinct a as src, b as dst from pairs where a <> b), deg as (select node, cast(sum(i) as bigint) as fan_in from (select src as node, 0 as i from edges union all select dst, 1 from edges) group by node), r as (select node, fan_in, case when lower(name) in ({', '.join(repr(x) for x in fx.UTILITIES)}) then 'utility_name' when fan_in > 5 then 'high_fan_in' end as reason from deg join entities using (node)) select * from r where reason is not null",
    "hotspots_top": f"with {ENTITY_EDGES}{_HOT} select node, coupling, risk, cast(row_number() over (order by risk desc, coupling desc, node) as int) as rank from hot where fan_in + fan_out >= 2 order by rank limit 20",
    "converged_pagerank": f"select node, round(rank, 6) as rank from ({_pagerank_sql(repo_edges_sql(), steps=60)})",
    "dependency_context_plain": f"with {ENTITIES}, edges as (select a as src, b as dst, cast(count(*) as double) as weight from pairs where a <> b group by a, b), u as (select node from entities where lower(name) in ({', '.join(repr(x) for x in fx.UTILITIES)})), e as (select dst as node, 'caller' as side, src as other, weight from edges union all select src, 'callee', dst, weight from edges), r as (select *, cast(row_number() over (partition by node, side order by weight desc, other) as int) as rank from e where other not in (from u)) select * from r where rank <= 3",
    "hotspot_tiers": f"with {ENTITY_EDGES}{_HOT}, x as (select node, risk, risk / (select max(risk) from hot) as ratio from hot) select node, risk, case {' '.join(f"when ratio >= {(9 - i) / 10}::double then '{t}'" for i, t in enumerate(fx.DECILES[:-1]))} else '{fx.DECILES[-1]}' end as tier, risk >= 10 as above_threshold from x",
}
