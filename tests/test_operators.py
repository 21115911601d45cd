from itertools import permutations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quarrylens.operators import audit, clones, detectors, graph, history, retrieval


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def test_closure_has_self_pairs_of_cycles(spark):
    found = graph.closure(edges(spark, ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)))
    pairs = {(r.src, r.dst) for r in found.collect()}
    assert ("a", "a") in pairs and ("d", "d") not in pairs and ("a", "d") in pairs and len(pairs) == 12
    assert {r.node: r.cycle for r in graph.cycles(found).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert graph.cycles(found.limit(0)).count() == 0
    assert graph.closure(found, 1).count() == 12


@pytest.mark.parametrize("alone", [0, 1000])
def test_components_and_reach_against_brute_force(spark, alone, monkeypatch):
    import random

    monkeypatch.setattr(graph.strong_components, "__defaults__", (alone,))
    random.seed(11)
    names = [f"n{i:02}" for i in range(30)]
    pairs = sorted({(random.choice(names), random.choice(names)) for _ in range(42)})
    reach = {(a, b) for a, b in pairs}
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    want = {a: min(b for b in names if (a, b) in reach and (b, a) in reach) for a in names if (a, a) in reach}
    e = edges(spark, *[(a, b, 1) for a, b in pairs])
    assert {r.node: r.cycle for r in graph.cycles(e).collect()} == want
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    condensed = graph.condense(e, nodes)
    assert graph.propagation(e, nodes, condensed).first().reachable == len(reach)
    below = {r.node: r.descendants for r in graph.descendants(condensed).collect()}
    assert below == {a: n for a in names if (n := sum((a, b) in reach for b in names if a != b))}
    modules = nodes.withColumn("module", F.substring("node", 1, 2))
    inside = {r.module: r.internal for r in graph.module_coupling(e, modules, condensed).collect()}
    for m in ("n0", "n1", "n2"):
        held = [x for x in names if x.startswith(m)]
        assert inside[m] == pytest.approx(sum((a, b) in reach for a in held for b in held) / (10 * 9))
    assert graph.propagation(e, nodes, None).first().status == "APPROXIMATE"


def test_closure_of_nothing(spark):
    assert graph.closure(edges(spark).limit(0)).count() == 0


def test_resolution(spark):
    entities = spark.createDataFrame(
        [("f::A::1", "f", 1, 20, "A", "A", False, False), ("f::get::2", "f", 2, 9, "get", "A.get", False, False), ("f::go::10", "f", 10, 20, "go", "go", False, False), ("g::go::1", "g", 1, 5, "go", "go", False, True), ("g::log::6", "g", 6, 9, "log", "log", True, False)],
        "node string, file string, first int, last int, name string, qualified string, utility boolean, test boolean",
    )
    references = spark.createDataFrame(
        [("f", 3, "go", "call", None), ("f", 12, "get", "call", "A"), ("f", 13, "get", "call", "other"), ("f", 14, "log", "call", None), ("f", 15, "go", "call", None), ("f", 99, "go", "call", None)],
        "file string, line int, target string, kind string, receiver string",
    )
    found = {(r.src, r.dst): round(r.weight, 4) for r in graph.build_edges(graph.resolve(references, entities)).collect()}
    half = 1.5 / 2**0.5
    assert found == {
        ("f::get::2", "f::go::10"): round(half, 4), ("f::get::2", "g::go::1"): round(half * 0.3, 4), ("f::go::10", "f::get::2"): 1.5, ("f::go::10", "g::log::6"): 0.15, ("f::go::10", "g::go::1"): round(half * 0.3, 4),
    }


def test_pagerank_sums_to_one(spark):
    ranks = graph.pagerank(edges(spark, ("a", "b", 1), ("b", "c", 3), ("a", "c", 1), ("d", "c", 2)))
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    assert ranks.orderBy(F.desc("rank")).first().node == "c"


def test_betweenness_against_all_paths(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "d", 1), ("d", "a", 1), ("b", "d", 5)]
    weight = {(s, d): w for s, d, w in rows}
    names = "abcd"

    def paths(s, t):
        out = []
        for n in range(0, 3):
            for mid in permutations([x for x in names if x not in (s, t)], n):
                p = (s, *mid, t)
                if all(x in weight for x in zip(p, p[1:])):
                    out.append((sum(weight[x] for x in zip(p, p[1:])), p))
        best = min((x[0] for x in out), default=None)
        return [p for w, p in out if w == best]

    want = dict.fromkeys(names, 0.0)
    for s in names:
        for t in names:
            if s != t:
                short = paths(s, t)
                for p in short:
                    for x in p[1:-1]:
                        want[x] += 1 / len(short)
    e = edges(spark, *rows)
    got = {r.node: r.betweenness for r in graph.betweenness(e, spark.createDataFrame([(x,) for x in names], "node string")).collect()}
    assert got == pytest.approx({k: v / 6 for k, v in want.items()})


def test_upstream_hides_but_passes(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 1), ("c", "d", 1))
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "node string, rank double")
    assert {(r.node, r.depth) for r in graph.upstream(e, "c", importance=ranks, least=0.1).collect()} == {("a", 2)}
    assert {r.path[-1] for r in graph.simple_paths(e, "a", "d").collect()} == {"d"}


def test_fusion_ties_share_a_rank(spark):
    signals = spark.createDataFrame([("bm25", "a", 0.8), ("bm25", "b", 0.8), ("bm25", "c", 0.5)], "signal string, node string, score double")
    found = {r.node: r.score for r in retrieval.fuse(signals, {"bm25": 4.0}).collect()}
    assert found == pytest.approx({"a": 4 / 30, "b": 4 / 30, "c": 4 / 32})
    assert retrieval.mode_of("", True) == "map" and retrieval.mode_of("x", False) == "query_bm25"


def test_budgets(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 30)], "g string, id int, t int")
    assert [r.id for r in retrieval.budget_stop(rows, [F.col("id")], F.col("t"), 100, ["g"]).collect()] == [1]
    assert [(r.id, r.used) for r in retrieval.budget_skip(rows, "g", F.col("id"), "id", "t", 100).collect()] == [(1, 60), (3, 90)]


def test_blocks_and_combined_score(spark):
    m = spark.createDataFrame([(1, 2, i, i + 3, 1.0) for i in range(5)] + [(1, 2, 7, 1, 0.9)], "a int, b int, pos_a int, pos_b int, similarity double")
    row = clones.blocks(m).first()
    assert (row.matched, row.max_block) == (6, 5)
    score = spark.range(1).select(clones.combined_score(F.lit(0.9), F.lit(0.6), F.lit(5)).alias("x"), clones.combined_score(F.lit(None).cast("double"), F.lit(0.6), F.lit(0)).alias("y"), clones.combined_score(F.lit(0.0), F.lit(0.0), F.lit(9)).alias("z")).first()
    assert score.x == pytest.approx(1 / (0.65 / 0.9 + 0.35 / 0.6) + 0.03) and score.y == pytest.approx(0.21) and score.z == 0


def test_clone_lines(spark):
    text = "def alpha(one):\n    return one + two\n    x\nshort(ab, cd)"
    rows = spark.createDataFrame([("p", text), ("q", text.replace("two", "three")), ("r", "nothing here at all\nto see at all")], "id string, text string")
    found = clones.syntactic(rows, "id", "text").collect()
    assert [(r.a, r.b, r.total) for r in found] == [("p", "q", 3)]


def test_parameter_groups(spark):
    rows = [(f"f{i}", p) for i in range(5) for p in ("host", "port")] + [(f"f{i}", "timeout") for i in range(3)] + [("g", "host")]
    found = detectors.parameter_groups(spark.createDataFrame(rows, "node string, param string"), 3)
    assert found == [(["host", "port"], 5), (["host", "port", "timeout"], 3)] or found == [(["host", "port", "timeout"], 3), (["host", "port"], 5)]


def test_magic_and_dead_code(spark):
    rows = spark.createDataFrame([("a", "42")] * 3 + [("b", "42")] + [("a", "7")] * 3 + [("a", "1"), ("b", "1"), ("c", "1")], "file string, value string")
    assert [(r.value, r.uses, r.files) for r in detectors.magic_constants(rows).collect()] == [("42", 4, 2)]
    entities = spark.createDataFrame([("n1", "f", "function", 9, False, False, False, None), ("n2", "g", "function", 9, False, False, True, None), ("n3", "h", "function", 2, False, False, False, None), ("n4", "m", "method", 9, False, False, False, "C")], "node string, name string, kind string, lines int, test boolean, private boolean, decorated boolean, parent string")
    found = {r.node: r.confidence for r in detectors.unreferenced(entities, edges(spark, ("x", "y", 1))).collect()}
    assert found == {"n1": 0.7, "n4": 0.65}
    used = spark.createDataFrame([("f",)], "name string")
    assert [r.node for r in detectors.unreferenced(entities, edges(spark, ("x", "y", 1)), used).collect()] == ["n4"]


def test_package_resolution(spark):
    modules = spark.createDataFrame([("a.b.c.X",), ("a.bc",), ("z",)], "module string")
    packages = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",)], "package string")
    assert {(r.module, r.package) for r in audit.resolve_packages(modules, packages).collect()} == {("a.b.c.X", "a.b.c"), ("a.bc", "a")}


def test_history(spark):
    hunks = spark.createDataFrame([(1, 3), (10, 0), (20, 5)], "start int, lines int")
    assert [r.start for r in history.overlapping_hunks(hunks, 3, 10).collect()] == [1, 10]
    a = spark.createDataFrame([("x", 1), ("y", 1), ("w", 2)], "f string, s int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "f string, s int")
    assert {(r.f, r.change) for r in history.differences(a, b, "f", ["s"]).collect()} == {("x", "unchanged"), ("y", "modified"), ("w", "deleted"), ("z", "added")}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    key = texts.where("text = 'a'").select(F.md5(F.concat(F.lit("m\0"), F.col("text"))).alias("text_md5"), F.array(F.lit(1.0)).alias("embedding"))
    hit, miss = history.cached_or_new(texts, key, "m")
    assert [r.text for r in hit.collect()] == ["a"] and [r.text for r in miss.collect()] == ["b"]


def test_bottlenecks_keep_light_edges(spark, sf):
    from quarrylens.plans import bindings, graphs

    edges = bindings.repo_edges(spark, sf)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    want = {r.node: r.betweenness for r in graph.betweenness(edges, nodes).where("betweenness >= 0.001").collect()}
    assert edges.where("weight < 3").count() and {r.node: r.betweenness for r in graphs.bottlenecks(spark, sf).collect()} == pytest.approx(want, abs=1e-5)


def test_limits_orders_and_signals(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "node string, score double")
    order = [F.desc("score")]
    assert [r.node for r in retrieval.limited(rows, 2, order).collect()] == ["a", "b"] and retrieval.limited(rows, 0, order).count() == retrieval.limited(rows, None, order).count() == 3
    assert [r.node for r in retrieval.limited(rows, 2, order, reverse=True).collect()] == ["b", "a"]
    signals = [retrieval.Signal("one", lambda e, q: e.select("node", F.lit(1.0).alias("score")), {"map": 1.0}), retrieval.Signal("two", lambda e, q: e.select("node", F.lit(2.0).alias("score")), {"query_bm25": 1.0})]
    assert {r.signal for r in retrieval.run_signals(signals, rows, [], "map").collect()} == {"one"} and retrieval.run_signals(signals, rows, [], "none").count() == 0


def test_similar_vectors_lose_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    points = np.repeat(rng.standard_normal((40, 16)), 6, axis=0) + 0.5 * rng.standard_normal((240, 16))
    points[200:220] = points[0]
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(unit)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("cell", F.lit("x"))
    kept = [i for i in range(240) if not 200 <= i < 220]
    for least, pivots in ((0.9, 16), (0.2, 5)):
        got = {(r.a, r.b): (r.similarity, r.copies_a) for r in clones.similar_vectors(df, "id", "v", least, pivots).collect()}
        want = {(a, b) for x, a in enumerate(kept) for b in kept[x + 1 :] if unit[a] @ unit[b] >= least}
        assert set(got) == want and all(c == (21 if a == 0 else 1) for (a, _), (_, c) in got.items())
    assert clones.similar_vectors(df.limit(0), "id", "v", 0.9).count() == 0


def test_semantic_search_in_blocks_equals_broadcast(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieval, "BLOCK", 7)
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.where("id % 4 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    once, blocks = (sorted((r.query, r.id, round(r.cosine, 9)) for r in retrieval.semantic(df, "id", "v", asked, 0.1, most).collect()) for most in (1000, 0))
    assert once == blocks and once


def test_best_pairs_come_from_the_first(spark):
    rows = spark.createDataFrame([(i, i + 1, 1 - i / 100) for i in range(30)], "a long, b long, similarity double")
    assert [r.a for r in clones.best_pairs(rows, 2, F.col("a") % 5 == 4).orderBy("a").collect()] == [4, 9]
    assert clones.best_pairs(rows, 0).count() == 30


def test_bottleneck_summary(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "node string, betweenness double")
    assert graph.bottleneck_summary(rows).first().asDict() == {"analysed": 2, "above": 1, "average": 0.25, "most": 0.5}
    assert graph.bottleneck_summary(rows.limit(0)).first().most == 0.0


def test_reach_sums_form_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "closure", None)  # before, all pairs were formed
    monkeypatch.setattr(graph, "BLOCK", 4)
    pairs = [(f"n{i}", f"n{(i * 7 + j) % 40}") for i in range(40) for j in (1, 2) if (i * 7 + j) % 40 > i or i % 13 == 0]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    nodes = edges.selectExpr("explode(array(src, dst)) as node").distinct()
    reach = {a: {b for x, b in pairs if x == a} for a in {x for p in pairs for x in p}}
    for _ in range(40):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    whole = graph.condense(edges, nodes)
    row = graph.propagation(edges, nodes, whole).first()
    assert row.reachable == sum(map(len, reach.values())) > len(pairs)
    modules = nodes.selectExpr("node", "concat('m', cast(substring(node, 2) as int) % 3) as module")
    for r in graph.module_coupling(edges, modules, whole).collect():
        of = {x for x in reach if int(x[1:]) % 3 == int(r.module[1:])}
        assert r.internal == sum(len(reach[a] & of) for a in of) / (len(of) * (len(of) - 1))


def test_groups_of_one_task_are_those_of_the_rounds(spark, monkeypatch):
    params = spark.createDataFrame([(f"f{i}", "abcdefgh"[j]) for i in range(40) for j in range(8) if (i * (j + 3) + i // 5) % 4 < 2], "node string, param string")
    jobs = []
    first = DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda self: jobs.append(1) or first(self))
    alone = detectors.parameter_groups(params, 6)
    assert alone and not jobs  # before, each group took jobs of its own
    monkeypatch.setattr(detectors, "ALONE", 0)
    assert detectors.parameter_groups(params, 6) == alone and jobs


def test_graphs_without_edges_have_no_components(spark):
    assert not list(graph.packed_graph(iter([]))) and not list(graph.components_alone(iter([])))  # before, both raised
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    whole = graph.condense(edges(spark).limit(0), nodes)
    assert graph.propagation(edges(spark).limit(0), nodes, whole).first().reachable == 0


def test_pairs_across_a_hub_are_a_product(spark):
    """Two parts: many ways into a component of two nodes and out of it, and a chain beside it."""
    pairs = [(f"a{i}", "h1") for i in range(60)] + [("h1", "h2"), ("h2", "h1")] + [("h2", f"z{i}") for i in range(50)]
    pairs += [("a0", "s"), ("s", "t"), ("t", "z0"), ("p", "q"), ("q", "q"), ("q", "r"), ("p", "r")]
    reach = {a: {y for x, y in pairs if x == a} for a in {x for p in pairs for x in p}}
    for _ in range(8):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    e = edges(spark, *[(a, b, 1) for a, b in pairs])
    nodes = spark.createDataFrame([(x,) for x in reach], "node string")
    whole = graph.condense(e, nodes)
    assert graph.propagation(e, nodes, whole).first().reachable == sum(map(len, reach.values()))
    modules = nodes.withColumn("module", F.when(F.col("node").rlike("^[a-h]"), "x").otherwise("y"))
    for r in graph.module_coupling(e, modules, whole).collect():
        of = {x for x in reach if (x[0] <= "h") == (r.module == "x")}
        assert (r.internal, r.external) == (sum(len(reach[a] & of) for a in of) / (len(of) * (len(of) - 1)), sum((a in of) != (b in of) for a, b in pairs))
    packed = list(graph.packed_graph(iter(whole.links.toArrow().to_batches())))[-1]
    assert len(packed.column("flat")[0].as_py()) // 4 == 3  # of 116 links; before, all were passed on for each block
