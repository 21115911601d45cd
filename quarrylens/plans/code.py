"""Queries on the call graph of the source files themselves, and the whole way from a query to an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import clones, code, detectors, graph
from quarrylens.operators.retrieval import top
from quarrylens.plans.bindings import files
from quarrylens.session import cut
from quarrylens.sinks import formats
from quarrylens.sources import logs

QUERY = ["merge", "manifest", "cursor"]


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the files' texts say, read once."""
    return cut(code.newest_facts(files(spark, sf)))


def _linked(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    """The facts that make the call graph; without the entities' texts, which hold most of the bytes, unless they are asked for."""
    rows = code.newest_facts(files(spark, sf)).where("fact in ('entity', 'reference')")
    return cut(rows if texts else rows.withColumns({c: F.lit(None).cast("string") for c in ("text", "doc")}))


def code_entities(spark: SparkSession, sf: str) -> DataFrame:
    return code.code_entities(_facts(spark, sf)).select("node", "language", "name", "kind", "qualified", "first", "last", "complexity", "utility", "test", "private")


def scope_of_reference(spark: SparkSession, sf: str) -> DataFrame:
    """References with the innermost entity around them."""
    facts = _facts(spark, sf)
    keyed = code.code_references(facts).distinct()
    return graph.innermost_scope(keyed, code.code_entities(facts).select("file", "first", "last", "node"), ["file", "line", "target", "kind", "receiver"])


def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    facts = _linked(spark, sf)
    return graph.resolve(code.code_references(facts), code.code_entities(facts)).withColumn("weight", F.round("weight", 8))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return code.call_graph(_linked(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"), F.array_join("kinds", ",").alias("kinds"))


def code_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    facts = _linked(spark, sf)
    return graph.hotspots(code.call_links(facts), code.code_entities(facts).select("node", "complexity"), 3)


def code_dead(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf)
    used = facts.where("fact = 'used'").select("name")
    return detectors.unreferenced(code.code_entities(facts), code.call_graph(facts), used)


def code_constants(spark: SparkSession, sf: str) -> DataFrame:
    rows = _facts(spark, sf).where("fact = 'literal'").select("file", F.col("text").alias("value"))
    return detectors.magic_constants(rows)


def code_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks seeded by the best lexical hits."""
    facts = _linked(spark, sf, texts=True)
    rows = code.signals(code.code_entities(facts), code.call_links(facts), code.call_links(facts, ["type", "inherit"]), QUERY, 10)
    return rows.select("signal", "node", F.round("score", 8).alias("score"))


def frame_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames printed from the last line of every function, read again, resolved to a file and to the function."""
    entities = cut(code.code_entities(_facts(spark, sf)))
    line = F.concat(F.lit('File "'), F.col("file"), F.lit('", line '), F.col("last"), F.lit(", in "), F.col("name"))
    frames = logs.stack_frames(entities.where("kind = 'function'").select("node", line.alias("trace")), "node", "trace")
    return code.frame_scopes(logs.local_file(frames, entities.select("file").distinct()), entities).select("id", "file", "line", "node")


def source_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every entity, cut out of its file by its lines."""
    entities = code.code_entities(_facts(spark, sf)).select("node", "file", "first", "last")
    return code.source_ranges(entities, files(spark, sf).where("content is not null")).select("node", F.length("source").alias("size"), F.md5("source").alias("digest"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return code.find_symbols(code.code_entities(_facts(spark, sf)), "get").select("node", "qualified", "first", "last")


def code_search(spark: SparkSession, sf: str) -> DataFrame:
    """The answer to a query in 2 000 tokens, as XML elements in order."""
    facts = _linked(spark, sf, texts=True)
    entities = code.code_entities(facts)
    scores = code.signals(entities, code.call_links(facts), code.call_links(facts, ["type", "inherit"]), QUERY, 10)
    rows = code.ranked(entities, cut(scores)).join(entities.select("node", "file", "first", "text"), "node")
    rows = rows.withColumn("score", F.round("score", 8)).withColumn("body", fx.snippet(F.col("text")))
    kept = code.within_budget(rows, 2000, 50, 15, fx.token_estimate(F.col("body")), [F.desc("score"), F.col("node")], 200)
    return formats.as_xml(top(kept, 200, [F.col("used")]).withColumn("at", F.col("first")), "entity", ["rank", "node", "at"], "body")


def code_clones(spark: SparkSession, sf: str) -> DataFrame:
    """Like functions by their lines, comparable ones only, neither nested nor in one another's file."""
    entities = cut(code.code_entities(_facts(spark, sf)))
    found = clones.syntactic(clones.comparable(entities), "node", "text")
    ends = lambda x: entities.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("file", "first", "last")])
    rows = found.join(ends("a"), "a").join(ends("b"), "b")
    nested = clones.nested(F.col("file_a"), F.col("first_a"), F.col("last_a"), F.col("file_b"), F.col("first_b"), F.col("last_b"))
    return rows.where(~nested).select("a", "b", F.round("share", 6).alias("share"), "matched", "total", "max_block", "category")


def encoder_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = code.code_entities(_facts(spark, sf)).where("text is not null")
    return rows.select("node", fx.semantic_text(F.col("name"), F.col("text")).alias("text"), fx.signature(F.col("text"), fx.head_lines(F.col("text"))).alias("signature"))


QUERIES = {f.__name__: f for f in (code_entities, scope_of_reference, resolved_references, call_edges, code_hotspots, code_dead, code_constants, code_ranks, frame_scopes, source_ranges, symbols, code_search, code_clones, encoder_texts)}
SQL: dict[str, str] = {}
