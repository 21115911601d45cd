"""Near-duplicate functions: shared lines, aligned blocks, vector similarity and their combination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.session import cut


def comparable(entities: DataFrame, min_lines: int = 3) -> DataFrame:
    """Functions that clones are looked for in: with text and lines enough, no classes and no tests."""
    return entities.where((F.col("kind") != "class") & (F.coalesce("text", F.lit("")) != "") & (F.col("lines") >= min_lines) & ~F.col("test"))


def best_pairs(pairs: DataFrame, most: int, keep: Column | None = None) -> DataFrame:
    """The ``most`` most similar pairs that are kept, out of the ten times as many most similar ones; all for 0."""
    if not most:
        return pairs if keep is None else pairs.where(keep)
    order = [F.desc("similarity"), F.col("a"), F.col("b")]
    first = pairs.orderBy(*order).limit(10 * most)
    return (first if keep is None else first.where(keep)).orderBy(*order).limit(most)


def function_lines(functions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, line, tokens)``: lines of five characters or more with two different tokens or more."""
    rows = functions.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    rows = rows.withColumn("tokens", F.array_distinct(F.filter(F.split("line", r"\W+"), lambda t: t != "")))
    rows = rows.where((F.length("line") >= 5) & (F.size("tokens") >= 2))
    order = Window.partitionBy("id").orderBy("pos")
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def candidates(lines: DataFrame, shared: int = 2, rare: int = 2, common: int = 20) -> DataFrame:
    """``(a, b, shared)``: functions with that many different lines in common that are in 2 to 20 functions.

    The frequency bound is the operator's definition of a telling line; it also bounds every key's pairs.
    """
    marks = lines.select("id", F.xxhash64("line").alias("h")).distinct()
    counts = marks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c").between(rare, common)).select("h")
    marks = marks.join(counts, "h")
    left, right = marks.toDF("h", "a"), marks.toDF("h", "b")
    return left.join(right, "h").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared)


def line_matches(pairs: DataFrame, lines: DataFrame, least: float = 0.70) -> DataFrame:
    """``(a, b, pos_a, pos_b, similarity)``: the best line of ``b`` for each line of ``a``; equal lines have 1.0.

    Lines compare by the Jaccard similarity of their tokens. Only lines that share a token meet: the join runs on
    (pair, token), never over all pairs of lines.
    """
    left = pairs.select("a", "b").join(lines.toDF("a", "pos_a", "line_a", "tokens_a"), "a")
    right = pairs.select("a", "b").join(lines.toDF("b", "pos_b", "line_b", "tokens_b"), "b")
    size = left.select("a", "b", "pos_a", F.size("tokens_a").alias("na"), F.explode("tokens_a").alias("token"))
    other = right.select("a", "b", "pos_b", F.size("tokens_b").alias("nb"), F.explode("tokens_b").alias("token"))
    common = size.join(other, ["a", "b", "token"]).groupBy("a", "b", "pos_a", "pos_b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    scored = common.select("a", "b", "pos_a", "pos_b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))
    order = Window.partitionBy("a", "b", "pos_a").orderBy(F.desc("similarity"), "pos_b")
    return scored.withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) & (F.col("similarity") >= least)).drop("n")


def blocks(matches: DataFrame, sure: float = 0.95) -> DataFrame:
    """``(a, b, matched, max_block)``: matched lines and the longest run of two or more lines that follow each other on both sides."""
    order = Window.partitionBy("a", "b").orderBy("pos_a")
    follows = (F.lag("pos_a").over(order) + 1 == F.col("pos_a")) & (F.lag("pos_b").over(order) + 1 == F.col("pos_b")) & (F.col("similarity") >= sure)
    runs = matches.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    runs = runs.groupBy("a", "b", "run").agg(F.count(F.lit(1)).alias("length"))
    longest = F.max(F.when(F.col("length") >= 2, F.col("length")).otherwise(0))
    return runs.groupBy("a", "b").agg(F.sum("length").alias("matched"), longest.alias("max_block"))


def syntactic(functions: DataFrame, id_col: str, text_col: str, line_least: float = 0.70, function_least: float = 0.50) -> DataFrame:
    """``(a, b, share, matched, total, max_block, category)``; the share counts lines of the smaller id."""
    lines = function_lines(functions, id_col, text_col)
    found = blocks(line_matches(candidates(lines), lines, line_least))
    totals = lines.groupBy(F.col("id").alias("a")).agg(F.count(F.lit(1)).alias("total"))
    out = found.join(totals, "a").where(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("total") * function_least)))
    share, block = F.col("matched") / F.col("total"), F.col("max_block")
    category = F.when(share >= 0.95, "EXACT").when((share >= 0.80) & (block >= 5), "NEAR").when(block >= 5, "STRUCTURAL").otherwise("PARTIAL")
    return out.select("a", "b", share.alias("share"), "matched", "total", "max_block", category.alias("category"))


#: Pivots of the similarity join, and rows of a task's share of a cell.
PIVOTS, SHARE = 256, 8192


def similar_vectors(vectors: DataFrame, id_col: str, vector_col: str, least: float, pivots: int = PIVOTS) -> DataFrame:
    """``(a, b, similarity, copies_a, copies_b)`` of all pairs of different unit vectors with that cosine, a < b.

    Equal vectors are one row, named by their smallest id and counted. Every vector belongs to the cell of its nearest
    pivot and visits the cells that can hold a partner: by the triangle inequality on angles, those whose pivot is no
    further from it than the cell's radius and the threshold's angle together. So nothing is lost, and how much meets
    depends on the threshold. The pivots are the vectors with the smallest hashes. Null vectors, and those of another
    dimension than the first pivot, don't come out.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = cut(base.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    schema = f"a {kind}, b {kind}, similarity double, copies_a bigint, copies_b bigint"
    chosen = [r.v for r in base.orderBy(F.xxhash64("id")).limit(pivots).select("v").collect()]
    chosen = [v for v in chosen if len(v) == len(chosen[0])]
    if not chosen:
        return spark.createDataFrame([], schema)
    table, reach, dims = np.array(chosen), float(np.arccos(np.clip(least, -1, 1))), len(chosen[0])

    def angles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        whole = np.flatnonzero(batch.column("v").value_lengths().to_numpy(zero_copy_only=False) == dims)
        flat = batch.column("v").take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return whole, np.arccos(np.clip(flat @ table.T, -1, 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, far = angles(batch)
            home = far.argmin(axis=1) if len(whole) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(whole)).columns, pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(whole)), home])], ["v", "id", "copies", "cell", "far"])

    owners = cut(base.mapInArrow(nearest, f"v array<double>, id {kind}, copies bigint, cell int, far double"))
    radius = np.full(len(chosen), -np.inf)
    shares = np.ones(len(chosen), int)
    for r in owners.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
        radius[r.cell], shares[r.cell] = r.far, -(-r.n // SHARE)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, far = angles(batch)
            at, cell = np.nonzero(far <= radius[None, :] + reach + 1e-9)
            times = shares[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            share = np.concatenate([np.arange(n) for n in times]) if len(times) else np.zeros(0, int)
            rows = batch.take(pa.array(whole[at]))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(cell.astype(np.int32)), pa.array(share.astype(np.int32)), pa.array(np.zeros(len(at), bool))], ["v", "id", "copies", "cell", "share", "own"])

    visitors = owners.mapInArrow(visits, f"v array<double>, id {kind}, copies bigint, cell int, share int, own boolean")
    split = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(shares)], "cell int, shares int"))
    mine = owners.join(split, "cell").select("v", "id", "copies", "cell", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), F.lit(True).alias("own"))

    def meet(rows: pa.Table) -> pa.Table:
        own = rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
        ids, copies = rows.column("id").to_numpy(zero_copy_only=False), rows.column("copies").to_numpy(zero_copy_only=False)
        points = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        o, w = np.flatnonzero(own), np.flatnonzero(~own)
        found = []
        for i in range(0, len(o), 1024):
            part = o[i : i + 1024]
            close = points[part] @ points[w].T
            x, y = np.nonzero((close >= least) & (ids[part][:, None] < ids[w][None, :]))
            found.append((part[x], w[y], close[x, y]))
        x, y, c = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))
        return pa.Table.from_arrays([pa.array(ids[x], rows.schema.field("id").type), pa.array(ids[y], rows.schema.field("id").type), pa.array(c, pa.float64()), pa.array(copies[x]), pa.array(copies[y])], ["a", "b", "similarity", "copies_a", "copies_b"])

    return mine.unionByName(visitors).groupBy("cell", "share").applyInArrow(meet, schema)


def combined_score(semantic: Column, syntactic_: Column, block: Column, ws: float = 0.65, wy: float = 0.35) -> Column:
    """Weighted harmonic mean if both are positive, else the weighted mean; 0.03 more for a block of five; at most 1."""
    s, y = F.coalesce(semantic, F.lit(0.0)), F.coalesce(syntactic_, F.lit(0.0))
    mean = F.when((s > 0) & (y > 0), (ws + wy) / (ws / F.when(s > 0, s) + wy / F.when(y > 0, y))).otherwise(ws * s + wy * y)
    return F.least(F.lit(1.0), F.when((s <= 0) & (y <= 0), 0.0).otherwise(mean + F.when(F.coalesce(block, F.lit(0)) >= 5, 0.03).otherwise(0.0)))


#: Categories of pairs from the closest on.
CATEGORIES = ["EXACT", "NEAR", "SEMANTIC-STRUCTURAL", "STRUCTURAL", "SEMANTIC", "PARTIAL"]


def combined_category(semantic: Column, syntactic_: Column, block: Column) -> Column:
    s, y, b = F.coalesce(semantic, F.lit(0.0)), F.coalesce(syntactic_, F.lit(0.0)), F.coalesce(block, F.lit(0))
    return (
        F.when((s >= 0.9999) & (y >= 0.95), "EXACT").when((s >= 0.98) & (y >= 0.80), "NEAR").when((s >= 0.95) & (y >= 0.50), "SEMANTIC-STRUCTURAL")
        .when((y >= 0.70) & (b >= 5), "STRUCTURAL").when(s >= 0.95, "SEMANTIC").otherwise("PARTIAL")
    )


def combine(by_vector: DataFrame, by_line: DataFrame) -> DataFrame:
    """``(a, b, similarity, share, score, category)``: a full outer join on the pair."""
    both = by_vector.select("a", "b", "similarity").join(by_line.select("a", "b", "share", "max_block"), ["a", "b"], "full")
    args = (F.col("similarity"), F.col("share"), F.col("max_block"))
    return both.select("a", "b", "similarity", "share", combined_score(*args).alias("score"), combined_category(*args).alias("category"))


#: What is suggested, and the scores it takes.
CONSOLIDATE, ALIKE, OTHER_LINES, SAME_LINES = 0.95, 0.95, 0.50, 0.70


def suggested_action(name_a: Column, name_b: Column, file_a: Column, file_b: Column, score: Column, semantic: Column, syntactic_: Column) -> Column:
    """The first that holds: equal names in two files, one file, a high combined score, like meaning in other lines, like lines."""
    s, y = F.coalesce(semantic, F.lit(0.0)), F.coalesce(syntactic_, F.lit(0.0))
    return (
        F.when((name_a == name_b) & (file_a != file_b), F.concat(F.lit("EXTRACT: Move '"), name_a, F.lit("' to shared utility module")))
        .when(file_a == file_b, "MERGE: Combine into single parameterized function")
        .when(score >= CONSOLIDATE, "CONSOLIDATE: High semantic and structural overlap")
        .when((s >= ALIKE) & (y < OTHER_LINES), "REVIEW: Similar behavior, different implementation")
        .when(y >= SAME_LINES, "CONSOLIDATE: High line-by-line overlap")
        .otherwise("REVIEW: Consider if these should be unified")
    )


def intentional(pairs: DataFrame) -> Column:
    """Whether two similar functions are alike on purpose.

    Columns: similarity, stub_a/b, lines_a/b, class_a/b, file_a/b, name_similarity.
    """
    s, n = F.col("similarity"), F.col("name_similarity")
    ratio = F.least("lines_a", "lines_b") / F.greatest("lines_a", "lines_b")
    short, same_file = (F.col("lines_a") <= 5) & (F.col("lines_b") <= 5), F.col("file_a") == F.col("file_b")
    return (
        F.when(F.col("stub_a") & F.col("stub_b"), True)
        .when(short & (s >= 0.95), True)
        .when((F.col("class_a") == F.col("class_b")) & (s >= 0.95), True)
        .when(s <= 0.97, False)
        .when((n >= 0.99) & ~same_file & (((F.col("lines_a") <= 10) & (F.col("lines_b") <= 10)) | (ratio > 0.7)), True)
        .when(same_file & (n >= 0.80), False)
        .when(same_file & (ratio > 0.7), True)
        .otherwise(n < 0.85)
    )


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, less the share of characters that differ."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))


def nested(file_a: Column, first_a: Column, last_a: Column, file_b: Column, first_b: Column, last_b: Column) -> Column:
    """One range holds the other in the same file."""
    return (file_a == file_b) & (((first_a <= first_b) & (last_a >= last_b)) | ((first_b <= first_a) & (last_b >= last_a)))
