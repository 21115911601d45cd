"""Ranked retrieval: BM25, vectors, rank fusion, roll-ups and token budgets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import cosine, words

K1, B, FUSION = 1.5, 0.75, 30


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, doc, tf)``."""
    terms = docs.select(F.col(id_col).alias("doc"), F.explode(words(F.col(text_col))).alias("term"))
    return terms.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(index: DataFrame, docs: int) -> DataFrame:
    """``(term, df, idf)``."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def doc_stats(index: DataFrame) -> DataFrame:
    """``(doc, terms)``: length in terms."""
    return index.groupBy("doc").agg(F.sum("tf").alias("terms"))


def _uses(term: str) -> Column:
    return F.size(F.filter("terms", lambda x: x == term))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], repeats: bool = False) -> DataFrame:
    """``(doc, score)`` of the documents that hold a query term. ``repeats``: a repeated query term counts again.

    Lengths come from the array's size, so only the postings of the query's terms leave the scan.
    """
    terms = words(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc"), terms.alias("terms")).where(F.size("terms") >= 0)
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("terms").cast("double")).alias("avg_len"))
    wanted = list(query) if repeats else list(dict.fromkeys(query))
    hits = rows.select("doc", F.size("terms").alias("len"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), _uses(t).alias("tf")) for t in wanted])).alias("h"))
    hits = hits.select("doc", "len", "h.*").where("tf > 0")
    df = hits.groupBy("term").agg(F.countDistinct("doc").alias("df"))  # one row per query term
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(totals))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("doc").agg(F.sum(idf * weight).alias("score")).where("score <> 0")


def static_idf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, score)``: the sum of idf over a document's different terms."""
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("term"))
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(total)).select("term", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return rows.join(idf, "term").groupBy("doc").agg(F.sum("idf").alias("score"))


#: Query vectors up to this many numbers (some 64 MB) are broadcast; more meet the vectors in blocks.
BROADCAST_NUMBERS = 8_000_000
#: Vectors of a block.
BLOCK = 8192


def semantic(vectors: DataFrame, id_col: str, vector_col: str, query: DataFrame, above: float = 0.1, most_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """``(query, id, cosine)`` above the cut-off; ``query(query, vector)``. Null vectors and other dimensions don't match."""
    asked = query.where("vector is not null").select("query", F.col("vector").alias("q"))
    stored = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    numbers = asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0)), F.count(F.lit(1))).first()
    if numbers[0] <= most_numbers:
        scored = stored.join(F.broadcast(asked), F.size("v") == F.size("q"))
    else:
        # every block of queries meets every block of vectors: each side is sent once per block of the other
        m, n = -(-numbers[1] // BLOCK), -(-stored.count() // BLOCK)
        a = asked.withColumn("m", F.pmod(F.xxhash64("query"), F.lit(m))).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
        b = stored.withColumn("n", F.pmod(F.xxhash64("id"), F.lit(max(1, n)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        scored = b.join(a, ["m", "n"]).where(F.size("v") == F.size("q"))
    return scored.select("query", "id", cosine(F.col("v"), F.col("q")).alias("cosine")).where(F.col("cosine") > above)


def top(rows: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows, with ``rank``; per group if ``by`` is given."""
    if by is None:
        rows = rows.orderBy(*order).limit(k)
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def limited(rows: DataFrame, most: int | None, order: list[Column], reverse: bool = False) -> DataFrame:
    """The first rows in order, all for 0, None or less; ``reverse`` shows them from the last to the first."""
    rows = top(rows, most, order) if most and most > 0 else rows.withColumn("rank", F.lit(None).cast("int"))
    return rows.orderBy(F.desc("rank")) if reverse and most and most > 0 else rows


@dataclass(frozen=True)
class Signal:
    """A score per node from entities and a query, its weights by mode, and how a class takes its methods' scores."""

    name: str
    compute: Callable[[DataFrame, list[str]], DataFrame]
    weights: dict[str, float]
    aggregate: str | None = None


def run_signals(signals: list[Signal], entities: DataFrame, query: list[str], mode: str) -> DataFrame:
    """``(signal, node, score)`` of the signals that count in a mode; ``compute`` gives ``(node, score)``."""
    parts = [x.compute(entities, query).select(F.lit(x.name).alias("signal"), "node", "score") for x in signals if mode in x.weights]
    if not parts:
        return entities.select(F.lit("").alias("signal"), "node", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def fuse(signals: DataFrame, weights: dict[str, float], penalties: DataFrame | None = None, semantic_weak: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: reciprocal rank fusion of ``signals(signal, node, score)``.

    Ties share a rank and the next rank skips. ``penalties(node, penalty)`` are added to the rank: 20 for private, 10
    for tests, 5 for methods in maps. Nodes of ``semantic_weak(node)`` keep 0.4 of their score.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    known = signals.withColumn("w", F.try_element_at(table, F.col("signal"))).where("w is not null")
    # equal scores are counted before they are ordered, so a signal's single ordered pass sees different scores only
    ties = known.groupBy("signal", "score").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("signal").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.select("signal", "score", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("rank"))
    ranked = known.join(ranks, (known["signal"] == ranks["signal"]) & known["score"].eqNullSafe(ranks["score"])).select("node", "w", "rank")
    if penalties is not None:
        ranked = ranked.join(penalties, "node", "left").withColumn("rank", F.col("rank") + F.coalesce("penalty", F.lit(0)))
    fused = ranked.groupBy("node").agg(F.sum(F.col("w") / (FUSION + F.col("rank"))).alias("score"))
    if semantic_weak is not None:
        weak = semantic_weak.select("node").distinct().withColumn("weak", F.lit(True))
        fused = fused.join(weak, "node", "left").select("node", F.when(F.col("weak"), F.col("score") * 0.4).otherwise(F.col("score")).alias("score"))
    return fused


#: Weights of the signals by mode, and how a class takes the scores of its methods.
SIGNALS = {
    "map": {"bm25": 0.3, "pr": 0.5, "bt": 0.5, "dispatcher": 0.5, "entry": 1.5, "type_ref": 1.0},
    "query_bm25": {"bm25": 4.0, "pr": 0.5, "bt": 0.5, "type_ref": 0.3},
    "query_semantic": {"semantic": 6.0, "pr": 0.3, "bt": 0.5, "type_ref": 0.3},
}
ROLL_UP = {"pr": "sqrt", "bt": "max", "dispatcher": "sqrt", "entry": "sqrt", "type_ref": "sqrt", "simple": "sqrt"}


def mode_of(query: str, has_vectors: bool) -> str:
    if not query.strip():
        return "map"
    return "query_semantic" if has_vectors else "query_bm25"


def roll_up(scores: DataFrame, members: DataFrame, damping: float = 0.3) -> DataFrame:
    """``(signal, node, score)`` with 0.3 of their methods' combined scores added to classes; ``members(node, parent)``."""
    inner = scores.join(members.where("parent is not null"), "node").groupBy("signal", F.col("parent").alias("node"))
    sums = inner.agg(F.sum("score").alias("total"), F.max("score").alias("most"))
    table = F.create_map(*[F.lit(x) for pair in ROLL_UP.items() for x in pair])
    how = F.try_element_at(table, F.col("signal"))
    added = sums.select("signal", "node", F.when(how == "sqrt", F.sqrt("total")).when(how == "max", F.col("most") + F.col("total")).otherwise(0.0).alias("added"))
    out = scores.join(added, ["signal", "node"], "full")
    return out.select("signal", "node", (F.coalesce("score", F.lit(0.0)) + damping * F.coalesce("added", F.lit(0.0))).alias("score"))


def find_identifiers(rows: DataFrame, id_col: str, name_col: str, wanted: str, text_col: str | None = None) -> DataFrame:
    """``(id, name, score)``: 100 equal, 75 begins, 50 contains, 25 only in the text, in any case."""
    low, needle = F.lower(name_col), wanted.lower()
    score = F.when(low == needle, 100).when(low.startswith(needle), 75).when(low.contains(needle), 50)
    if text_col:
        score = score.when(F.lower(text_col).contains(needle), 25)
    return rows.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), score.alias("score")).where("score is not null")


def budget_stop(rows: DataFrame, order: list[Column], tokens: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order until the first that exceeds the budget."""
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(window)).where(F.col("used") <= budget)


def budget_skip(rows: DataFrame, by: str, order: Column, id_col: str, tokens: str, budget: int) -> DataFrame:
    """``(by, id, used)``: rows in order, skipping each that doesn't fit; the fold runs inside one expression per group.

    ``order`` must be one comparable column; groups are result lists, not whole tables.
    """
    listed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(id_col).alias("id"), F.col(tokens).cast("bigint").alias("t")))).alias("l"))
    kind = f"struct<used:bigint,kept:array<struct<id:{rows.schema[id_col].dataType.simpleString()},used:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().alias("kept")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        used = state["used"] + x["t"]
        kept = F.concat(state["kept"], F.array(F.struct(x["id"].alias("id"), used.alias("used"))))
        return F.when(used <= budget, F.struct(used.alias("used"), kept.alias("kept"))).otherwise(state).cast(kind)

    folded = listed.select(by, F.aggregate("l", start, step)["kept"].alias("kept"))
    return folded.select(by, F.inline("kept"))


def simple_map(entities: DataFrame, blame: DataFrame | None, members: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: different commits on an entity's lines plus lines / 1e6; the line count alone without any blame.

    ``entities(node, file, first, last)``, ``blame(file, start, upto, commit)`` with ranges of lines. With ``members(node,
    parent)`` classes take 0.3 of the root of their methods' sum.
    """
    size = (F.col("last") - F.col("first") + 1).alias("lines")
    if blame is None:
        scores = entities.select("node", size).select("node", F.col("lines").cast("double").alias("score"))
    else:
        hits = entities.select("node", "file", "first", "last").join(blame, "file").where("start <= last and upto >= first")
        commits = hits.groupBy("node").agg(F.countDistinct("commit").alias("commits"))
        scores = entities.select("node", size).join(commits, "node", "left").select("node", (F.coalesce("commits", F.lit(0)) + F.col("lines") / 1e6).alias("score"))
    if members is None:
        return scores
    return roll_up(scores.withColumn("signal", F.lit("simple")), members).select("node", "score")
