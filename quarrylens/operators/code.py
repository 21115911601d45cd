"""From source files to a ranked answer: entities and references, the call graph, signals, fusion, budget and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import graph, retrieval
from quarrylens.sources import tree

#: Ranks added for private names and tests; best lexical hits that seed the personalised ranks.
PRIVATE, TEST, SEEDS = 20, 10, 30


def code_entities(facts: DataFrame) -> DataFrame:
    """``(node, file, language, name, kind, parent, qualified, first, last, lines, complexity, utility, test, private, doc, text)``."""
    rows = facts.where("fact = 'entity' and name is not null")
    return rows.select(
        fx.node_id(F.col("file"), F.col("name"), F.col("line")).alias("node"), "file", "language", "name", "kind", "parent", fx.qualified_name(F.col("parent"), F.col("name")).alias("qualified"), F.col("line").alias("first"), "last",
        fx.line_count(F.col("line"), F.col("last")).alias("lines"), "complexity", fx.is_utility(F.col("name")).alias("utility"), fx.is_test(F.col("name"), F.col("file")).alias("test"), fx.is_private(F.col("name"), F.col("language")).alias("private"),
        "decorated", "stub", "doc", "text",
    )


def code_references(facts: DataFrame) -> DataFrame:
    """``(file, line, target, kind, receiver)``."""
    return facts.where("fact = 'reference' and name is not null").select("file", "line", F.col("name").alias("target"), "kind", F.col("parent").alias("receiver"))


def call_graph(facts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``(src, dst, weight, kinds)`` of the references that resolve, perhaps of some kinds only."""
    return graph.linked_edges(call_links(facts, kinds))


def call_links(facts: DataFrame, kinds: list[str] | None = None) -> graph.Links:
    """The call graph by names: what sums over it needs no pair of its nodes."""
    references = code_references(facts)
    if kinds:
        references = references.where(F.col("kind").isin(kinds))
    return graph.links(references, code_entities(facts))


def class_members(entities: DataFrame) -> DataFrame:
    """``(node, parent)``: methods with the class entity of their file that bears their parent's name, the last above them."""
    classes = entities.where("kind = 'class'").select("file", F.col("name").alias("parent"), F.col("node").alias("class"), F.col("first").alias("at"))
    held = entities.where("parent is not null").select("node", "file", "parent", "first").join(classes, ["file", "parent"]).where("at <= first")
    return held.groupBy("node").agg(F.max_by("class", "at").alias("parent"))


def find_symbols(entities: DataFrame, name: str, file: str | None = None, line: int | None = None) -> DataFrame:
    """Entities of a plain or qualified name, in files whose path ends so and around a line if given."""
    rows = entities.where((F.col("name") == name) | (F.col("qualified") == name))
    if file:
        rows = rows.where((F.col("file") == file) | F.col("file").endswith("/" + file))
    if line is not None:
        rows = rows.where(F.lit(line).between(F.col("first"), F.col("last")))
    return rows


def source_ranges(ranges: DataFrame, files: DataFrame, around: int = 0) -> DataFrame:
    """``(*ranges, source)``: the lines ``first`` to ``last`` of ``files(file, content)``, and some around them."""
    lines = F.split("content", r"\r\n|\r|\n")
    start = F.greatest(F.lit(1), F.col("first") - around)
    return ranges.join(files.select("file", "content"), "file").withColumn("source", F.array_join(F.slice(lines, start, F.greatest(F.lit(0), F.col("last") + around - start + 1)), "\n")).drop("content")


def frame_scopes(frames: DataFrame, entities: DataFrame) -> DataFrame:
    """Stack frames ``(id, pos, local, line)`` with the innermost entity around their line; frames outside any stay, with null."""
    keyed = frames.select("id", "pos", F.col("local").alias("file"), "line")
    inside = graph.innermost_scope(keyed.where("file is not null"), entities.select("file", "first", "last", "node"), ["id", "pos"])
    return keyed.join(inside.select("id", "pos", "node"), ["id", "pos"], "left")


def signals(entities: DataFrame, edges: DataFrame | graph.Links, types: DataFrame | graph.Links, query: list[str], steps: int | None = None) -> DataFrame:
    """``(signal, node, score)``: lexical hits, ranks seeded by the best of them, and ranks by references to types."""
    text = fx.searchable_text(F.col("name"), F.col("kind"), F.coalesce("doc", F.lit("")), F.col("text"))
    lexical = retrieval.bm25(entities.select("node", text.alias("t")), "node", "t", query).toDF("node", "score")
    seeds = lexical.orderBy(F.desc("score"), "node").limit(SEEDS).select("node", F.col("score").alias("weight"))
    exact = {} if steps is None else {"steps": steps, "tolerance": None}
    linked = graph.nodes_of(edges)
    parts = {"bm25": lexical}
    if not linked.join(seeds, "node", "left_semi").isEmpty():
        parts["pr"] = graph.pagerank(edges, teleport=seeds, **exact).toDF("node", "score")
    if not graph.nodes_of(types).isEmpty():
        parts["type_ref"] = graph.pagerank(types, **exact).toDF("node", "score")
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("signal"), "node", "score") for k, x in parts.items()])


def ranked(entities: DataFrame, scores: DataFrame, mode: str = "query_bm25") -> DataFrame:
    """``(node, score)`` after roll-up into classes, fusion and penalties for private names and tests.

    Without a lexical hit in a semantic query, the lexical weights take over.
    """
    if mode == "query_semantic" and scores.where("signal = 'semantic'").isEmpty():
        mode = "query_bm25"
    rolled = retrieval.roll_up(scores, class_members(entities))
    penalties = entities.select("node", (F.when(F.col("private"), PRIVATE).otherwise(0) + F.when(F.col("test"), TEST).otherwise(0)).alias("penalty"))
    return retrieval.fuse(rolled, retrieval.SIGNALS[mode], penalties)


def within_budget(rows: DataFrame, budget: int, overhead: int, per_row: int, tokens: Column, order: list[Column], most: int) -> DataFrame:
    """The best ``most`` rows, of which those stay that fit the budget one after the other, larger ones skipped.

    The answer costs ``overhead`` tokens and each row ``per_row`` beside its text.
    """
    first = retrieval.top(rows.withColumn("tokens", tokens + per_row), most, order)
    kept = retrieval.budget_skip(first.withColumn("answer", F.lit(0)), "answer", F.col("rank"), "rank", "tokens", budget - overhead)
    return first.join(kept.select(F.col("id").alias("rank"), "used"), "rank")


def newest_facts(files: DataFrame) -> DataFrame:
    return tree.facts(files.where("file is not null"))
