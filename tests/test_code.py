"""The call graph and the search pipeline against SQL on the facts, written out as a table, and against fixtures."""

import duckdb
import pytest
from oracle import rows
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import code, graph, retrieval, store
from quarrylens.plans import bindings
from quarrylens.plans import code as plans

TEXT = {
    "r/a.py": "class Box:\n    def get(self):\n        return load(1)\n\n    def put(self, x):\n        self.get()\n        load(x)\n\ndef load(n):\n    print(n)\n    return _deep(n)\n\ndef _deep(n):\n    return n\n",
    "r/test_a.py": "from a import load\n\ndef test_load():\n    load(2)\n",
    "r/none.py": None,
    "r/broken.py": "def (",
}


@pytest.fixture(scope="module")
def facts(spark):
    return code.newest_facts(spark.createDataFrame(list(TEXT.items()), "file string, content string"))


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    """The facts of the test data as a table for DuckDB."""
    folder = str(tmp_path_factory.mktemp("facts") / "t")
    code.newest_facts(bindings.files(spark, sf)).write.parquet(folder)
    db = duckdb.connect()
    db.execute(f"create view facts as select * from '{folder}/*.parquet'")
    utilities = ", ".join(repr(x) for x in fx.UTILITIES)
    db.execute(f"""create table ents as select file || '::' || name || '::' || line as node, file, language, name, kind, parent, case when coalesce(parent, '') <> '' then parent || '.' || name else name end as qualified, line as first, last, complexity,
      lower(name) in ({utilities}) as utility, regexp_matches(lower(name), '^(test|spec)|(test|spec)$') or regexp_matches(lower(regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '')), '^(test_|spec_)|(_test|_spec)$') as test from facts where fact = 'entity' and name is not null""")
    db.execute("create table refs as select row_number() over () as ref, file, line, name as target, kind, parent as receiver from facts where fact = 'reference' and name is not null")
    db.execute("create table placed as select * from (select r.*, e.node as src, row_number() over (partition by ref order by e.last - e.first, e.first, e.node) as n from refs r join ents e on r.file = e.file and r.line between e.first and e.last) where n = 1")
    common = ", ".join(repr(x) for x in graph.AMBIGUOUS)
    db.execute("create table exact as select p.*, e.node as dst, e.utility, e.test from placed p join ents e on p.receiver || '.' || p.target = e.qualified where receiver is not null")
    db.execute(f"create table hits as select ref, src, kind, dst, utility, test from exact union all select p.ref, p.src, p.kind, e.node, e.utility, e.test from placed p join ents e on p.target = e.name where p.ref not in (select ref from exact) and not (p.receiver is not null and p.target in ({common}))")
    db.execute("create table resolved as select src, dst, kind, case kind when 'inherit' then 3.0 when 'call' then 1.5 when 'import' then 0.5 else 1.0 end / sqrt(count(*) over (partition by ref)) * case when utility then 0.1 else 1.0 end * case when test then 0.3 else 1.0 end as weight from hits")
    db.execute("create table edges as select src, dst, sum(weight) as weight, string_agg(distinct kind, ',' order by kind) as kinds from resolved where src <> dst group by src, dst")
    return db


def test_call_edges_as_sql(spark, sf, written):
    assert rows(plans.call_edges(spark, sf).toPandas()) == rows(written.execute("select src, dst, round(weight, 6) as weight, kinds from edges").df())


def test_entities_and_scopes_as_sql(spark, sf, written):
    assert rows(plans.scope_of_reference(spark, sf).toPandas()) == rows(written.execute("select distinct file, line, target, kind, receiver, src as node from placed").df())
    ours = plans.code_entities(spark, sf).select("node", "qualified", "utility", "test", "complexity").toPandas()
    assert rows(ours) == rows(written.execute("select node, qualified, utility, test, complexity from ents").df())


def test_hotspots_of_code_as_sql(spark, sf, written):
    theirs = written.execute("with d as (select node, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from (select src as node, 0 as i, 1 as o from edges union all select dst, 1, 0 from edges) group by node) select node, fan_in, fan_out from d where fan_in + fan_out >= 3").df()
    assert rows(plans.code_hotspots(spark, sf).select("node", "fan_in", "fan_out").distinct().toPandas()) == rows(theirs)


def test_source_ranges_cut_the_entity(spark, facts):
    files = spark.createDataFrame(list(TEXT.items()), "file string, content string")
    got = {r.node: r.source for r in code.source_ranges(code.code_entities(facts).select("node", "file", "first", "last"), files).collect()}
    assert got["r/a.py::_deep::13"] == "def _deep(n):\n    return n" and got["r/a.py::get::2"].startswith("    def get")
    around = code.source_ranges(code.code_entities(facts).where("name = 'load'").select("node", "file", "first", "last"), files, 1).first().source
    assert around.startswith("\n" + "def load") and around.endswith("\n")


def test_members_symbols_and_frames(spark, facts):
    entities = code.code_entities(facts)
    assert {(r.node, r.parent) for r in code.class_members(entities).collect()} == {("r/a.py::get::2", "r/a.py::Box::1"), ("r/a.py::put::5", "r/a.py::Box::1")}
    assert [r.node for r in code.find_symbols(entities, "Box.put", "a.py").collect()] == ["r/a.py::put::5"]
    assert code.find_symbols(entities, "load", line=1).count() == 0
    frames = spark.createDataFrame([("t", 0, "r/a.py", 6), ("t", 1, None, 3), ("t", 2, "r/a.py", 99)], "id string, pos int, local string, line int")
    assert {(r.pos, r.node) for r in code.frame_scopes(frames, entities).collect()} == {(0, "r/a.py::put::5"), (1, None), (2, None)}


def test_calls_prefer_the_receiver_and_tests_weigh_less(spark, facts):
    edges = {(r.src.split("::")[1], r.dst.split("::")[1]): r.weight for r in code.call_graph(facts).collect()}
    assert edges[("put", "get")] == pytest.approx(0.15) and edges[("put", "load")] == 1.5 and edges[("test_load", "load")] == 1.5
    assert ("load", "_deep") in edges and ("load", "print") not in edges


def test_ranked_rows_within_the_budget(spark, facts):
    entities = code.code_entities(facts).cache()
    scores = code.signals(entities, code.call_graph(facts), code.call_graph(facts, ["type"]), ["load"])
    assert {r.signal for r in scores.select("signal").distinct().collect()} == {"bm25", "pr"}
    ranks = code.ranked(entities, scores)
    assert ranks.orderBy(F.desc("score")).first().node == "r/a.py::load::9"
    kept = code.within_budget(ranks, 40, 10, 5, F.lit(10), [F.desc("score"), F.col("node")], 200).orderBy("rank").collect()
    assert [(r.rank, r.used) for r in kept] == [(1, 15), (2, 30)]
    assert code.signals(entities, code.call_graph(facts), code.call_graph(facts, ["type"]), ["nowhere"]).count() == 0


def test_index_is_reused_and_equals_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "graph cache graph"), (2, "cache only"), (3, None), (4, ""), (5, "other words here")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    folder = store.text_index(docs, "doc_id", "text")
    assert store.text_index(spark.read.parquet(path), "doc_id", "text") == folder and store.manifest(spark, folder)["docs"] == 4
    for repeats in (False, True):
        scan = {r.doc: round(r.score, 9) for r in retrieval.bm25(docs.where("text is not null"), "doc_id", "text", ["graph", "cache", "graph"], repeats).collect()}
        assert {r.doc: round(r.score, 9) for r in store.search(spark, folder, ["graph", "cache", "graph"], repeats).collect()} == scan
    assert store.search(spark, folder, ["absent"]).count() == 0 and store.search(spark, folder, []).count() == 0
    with pytest.raises(ValueError):
        store.search(spark, str(tmp_path / "nothing"), ["a"])
    spark.createDataFrame([(6, "graph")], "doc_id long, text string").write.mode("append").parquet(path)
    assert store.text_index(spark.read.parquet(path), "doc_id", "text") != folder


def linked_case(spark, duplicated):
    """Many references to few names, with and without receivers; perhaps with a node under two qualified names."""
    ents = [(f"f{i % 5}", f"f{i % 5}::{'abget'[i % 3:i % 3 + 1]}::{i}", i, i + 3, "abg"[i % 3], f"{'XY'[i % 2]}.{'abg'[i % 3]}", i % 7 == 0, i % 5 == 1) for i in range(40)]
    if duplicated:
        ents += [(ents[3][0], *ents[3][1:5], "Z.a", *ents[3][6:]), ents[4]]
    refs = [(f"f{i % 5}", 5 + i % 35, "abgq"[i % 4], ("call", "usage", "type")[i % 3], (None, "X", "Z", "W")[i // 3 % 4]) for i in range(300)]
    entities = spark.createDataFrame(ents, "file string, node string, first int, last int, name string, qualified string, utility boolean, test boolean")
    return spark.createDataFrame(refs, "file string, line int, target string, kind string, receiver string"), entities, refs, ents


@pytest.mark.parametrize("duplicated", [False, True])
def test_links_are_the_edges_without_their_pairs(spark, monkeypatch, duplicated):
    monkeypatch.setattr(graph, "SIDE", 3)  # blocks of a name meet in many tasks
    references, entities, refs, ents = linked_case(spark, duplicated)
    edges = {}
    for file, line, target, kind, receiver in refs:
        around = [e for e in ents if e[0] == file and e[2] <= line <= e[3]]
        if not around:
            continue
        src = min(around, key=lambda e: (e[3] - e[2], e[2], e[1]))[1]
        goals = [e for e in ents if receiver and e[5] == f"{receiver}.{target}"] or [e for e in ents if e[4] == target]
        for e in goals:
            if e[1] != src:
                w, k = edges.get((src, e[1]), (0.0, set()))
                edges[src, e[1]] = w + graph.EDGE_WEIGHTS[kind] / len(goals) ** 0.5 * (0.1 if e[6] else 1) * (0.3 if e[7] else 1), k | {kind}
    found = graph.links(references, entities)
    ours = graph.linked_edges(found)
    assert {(r.src, r.dst): (pytest.approx(r.weight), set(r.kinds)) for r in ours.collect()} == edges
    assert sum(r.weight for r in graph.resolve(references, entities).collect()) == pytest.approx(sum(w for w, _ in edges.values()))
    plain = ours.localCheckpoint()
    assert {tuple(r) for r in graph.degrees(found).collect()} == {tuple(r) for r in graph.degrees(plain).collect()}
    assert {r.node for r in graph.nodes_of(found).collect()} == {r.node for r in graph.nodes_of(plain).collect()}
    seeds = spark.createDataFrame([(ents[0][1], 1.0), (ents[8][1], 2.0)], "node string, weight double")
    ranks = {r.node: r.rank for r in graph.pagerank(plain, teleport=seeds, steps=4, tolerance=None).collect()}
    assert {r.node: pytest.approx(r.rank) for r in graph.pagerank(found, teleport=seeds, steps=4, tolerance=None).collect()} == ranks
    assert found.sources.count() <= len(refs) and found.targets.count() <= 2 * len(ents) + 2
