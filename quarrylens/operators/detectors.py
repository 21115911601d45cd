"""Unreferenced functions, parameters that travel together, repeated constants, likely secrets and echoing comments."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import cosine, preview, tier
from quarrylens.session import cut


def unreferenced(entities: DataFrame, edges: DataFrame, used_names: DataFrame | None = None, least: float = 0.5, min_lines: int = 3, private_too: bool = False) -> DataFrame:
    """``(node, name, confidence, severity)`` of functions nothing refers to.

    ``entities(node, name, kind, lines, test, private, decorated, parent)``. Two anti-joins: on incoming edges and on
    names used anywhere; then a confidence from a base of 0.85.
    """
    special = F.col("name").rlike("^__.*__$") | F.col("name").isin("init", "constructor")
    rows = entities.where((F.col("kind") != "class") & ~special & ~F.col("test") & (F.col("lines") >= min_lines))
    if not private_too:
        rows = rows.where(~F.col("private"))
    rows = rows.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    if used_names is not None:
        rows = rows.join(used_names.select("name").distinct(), "name", "left_anti")
    calls = edges.select(F.col("src").alias("node")).distinct().withColumn("calls", F.lit(True))
    rows = rows.join(calls, "node", "left")
    top_level, public = F.coalesce("parent", F.lit("")) == "", ~F.col("private")
    raw = (
        F.lit(0.85) - F.when(F.col("decorated"), 0.80).otherwise(0.0) + F.when(F.col("private"), 0.10).otherwise(0.0) - F.when(top_level & public & F.coalesce("calls", F.lit(False)), 0.50).otherwise(0.0)
        - F.when(~top_level, 0.20).otherwise(0.0) - F.when((F.col("kind") == "function") & top_level & public, 0.15).otherwise(0.0)
    )
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    out = rows.select("node", "name", F.round(confidence, 4).alias("confidence")).where(F.col("confidence") >= least)
    return out.withColumn("severity", tier(F.col("confidence"), (0.8, "high"), (0.5, "medium")))


def parameter_pairs(params: DataFrame, least: int = 3) -> DataFrame:
    """``(p, q, functions)``: pairs of parameters that so many functions take; ``params(node, param)``.

    Rare parameters leave before the self-join, as no frequent pair can hold one.
    """
    base = params.select("node", "param").distinct()
    often = base.groupBy("param").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("param")
    base = base.join(often, "param").select("node", "param")
    left, right = base.toDF("node", "p"), base.toDF("node", "q")
    return left.join(right, "node").where("p < q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("functions")).where(F.col("functions") >= least)


#: Different sets of parameters that one task searches alone, some 100 MB.
ALONE = 200_000


def groups_alone(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``(members, functions)``: the groups of ``parameter_groups`` from all ``(set, c)`` of one partition."""
    held = list(batches)
    if not sum(x.num_rows for x in held):
        return
    table = pa.Table.from_batches(held)
    sets, counts = [set(x) for x in table.column("set").to_pylist()], table.column("c").to_pylist()
    holders: dict[str, set[int]] = {}
    pairs: Counter[tuple[str, str]] = Counter()
    for i, (some, c) in enumerate(zip(sets, counts)):
        for x in some:
            holders.setdefault(x, set()).add(i)
        for pair in combinations(sorted(some), 2):
            pairs[pair] += c
    groups: dict[tuple[str, ...], int] = {}
    done: set[tuple[str, str]] = set()
    for (p, q), functions in sorted(((k, n) for k, n in pairs.items() if n >= least), key=lambda x: (-x[1], x[0])):
        if (p, q) in done:
            continue
        group, count, after, held = [p, q], functions, "", holders[p] & holders[q]
        while True:
            fits: Counter[str] = Counter()
            for i in held:
                for x in sets[i]:
                    fits[x] += counts[i]
            some = [x for x, c in fits.items() if c >= least and x not in group]
            if not some:
                break
            found = min(some, key=lambda x: (x <= after, x))
            group.append(found)
            count, after, held = fits[found], found, held & holders[found]
        if functions > count:
            groups.setdefault((p, q), functions)
        groups.setdefault(tuple(sorted(group)), count)
        done.update(combinations(sorted(group), 2))
    yield pa.RecordBatch.from_pydict({"members": pa.array([list(k) for k in groups], pa.list_(pa.string())), "functions": pa.array(list(groups.values()), pa.int64())})


def parameter_groups(params: DataFrame, least: int = 3) -> list[tuple[list[str], int]]:
    """Groups of parameters that travel together with their number of functions, best first by size * count.

    The most frequent pair (ties by name) grows by every parameter, in order of name, with which the group still has
    ``least`` functions; pairs inside a group are then done. Functions with equal parameters are one row with a count, and
    pairs stay in Spark: the driver holds only the groups found. Up to ``ALONE`` different sets of parameters are searched by
    one task; above that each group costs a few jobs, with the same result.
    """
    base = params.select("node", "param").distinct()
    pairs = cut(parameter_pairs(base, least))
    names = pairs.select(F.explode(F.array("p", "q")).alias("param")).distinct()
    sets = base.join(names, "param").groupBy("node").agg(F.sort_array(F.collect_set("param")).alias("set"))
    sets = cut(sets.where(F.size("set") >= 2).groupBy("set").agg(F.count(F.lit(1)).alias("c")))
    if sets.limit(ALONE + 1).count() <= ALONE:
        rows = sets.repartition(1).mapInArrow(lambda batches: groups_alone(batches, least), "members array<string>, functions bigint").collect()
        return sorted(((list(r.members), r.functions) for r in rows), key=lambda x: (-len(x[0]) * x[1], -len(x[0]), x[0]))

    def both_in(group: list[str]) -> Column:
        return F.col("p").isin(group) & F.col("q").isin(group)

    groups: dict[tuple[str, ...], int] = {}
    waiting, rounds = pairs, 0
    while True:
        seed = waiting.orderBy(F.desc("functions"), "p", "q").first()
        if seed is None:
            break
        group, count, after = [seed.p, seed.q], seed.functions, ""
        while True:
            holders = sets.where(F.size(F.array_except(F.array(*map(F.lit, group)), "set")) == 0)
            fits = holders.select(F.explode("set").alias("param"), "c").where(~F.col("param").isin(group)).groupBy("param").agg(F.sum("c").alias("c"))
            fits = fits.where(F.col("c") >= least).orderBy((F.col("param") <= after).cast("int"), "param").first()
            if fits is None:
                break
            group.append(fits.param)
            count, after = fits.c, fits.param
        if seed.functions > count:
            groups.setdefault(tuple(sorted((seed.p, seed.q))), seed.functions)
        groups.setdefault(tuple(sorted(group)), count)
        waiting, rounds = waiting.where(~both_in(group)), rounds + 1
        if rounds % 10 == 0:
            waiting = cut(waiting)
    return sorted(((list(k), v) for k, v in groups.items()), key=lambda x: (-len(x[0]) * x[1], -len(x[0]), x[0]))


#: Constants that need no name.
TRIVIAL = ["0", "1", "-1", "0.0", "1.0", "", '""', "''"]


def magic_constants(literals: DataFrame, min_uses: int = 3, min_files: int = 2, kind: str = "all") -> DataFrame:
    """``(value, uses, files, severity)`` of constants used so often in so many files; ``literals(file, value)``."""
    number = F.col("value").rlike(r"^[-+]?(0[xX][0-9a-fA-F]+|\d+(\.\d*)?([eE][-+]?\d+)?)$")
    rows = literals.where(F.col("value").isNotNull() & ~F.col("value").isin(TRIVIAL))
    if kind != "all":
        rows = rows.where(number if kind == "numeric" else ~number)
    out = rows.groupBy("value").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("file").alias("files"))
    return out.where((F.col("uses") >= min_uses) & (F.col("files") >= min_files)).withColumn("severity", tier(F.col("uses"), (10, "high"), (5, "medium")))


def scored_values(values: DataFrame, value_col: str, score_col: str, least: float = 0.35) -> DataFrame:
    """Values from a score on, with a preview of 40 characters at most and a severity."""
    rows = values.where(F.col(score_col) >= least)
    return rows.withColumn("value_preview", preview(F.col(value_col))).withColumn("severity", tier(F.col(score_col), (0.8, "high"), (0.5, "medium")))


def string_features(value: Column) -> dict[str, Column]:
    """Features of a string that tell secrets from text, all inside the JVM."""
    size = F.length(value)

    def share(pattern: str) -> Column:
        return F.when(size > 0, (size - F.length(F.regexp_replace(value, pattern, ""))) / size).otherwise(0.0)

    def is_(pattern: str) -> Column:
        return value.rlike(pattern).cast("int")

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    kinds = F.transform(chars, lambda c: F.when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4))
    changes = F.aggregate(kinds, F.struct(F.lit(0).alias("last"), F.lit(0).alias("n")), lambda a, k: F.struct(k.alias("last"), (a["n"] + F.when((a["last"] != 0) & (a["last"] != k), 1).otherwise(0)).alias("n")))["n"]
    run = F.aggregate(
        chars,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct(c.alias("last"), F.when(a["last"] == c, a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["most"], F.when(a["last"] == c, a["now"] + 1).otherwise(1)).alias("most")),
    )["most"]
    from quarrylens.functions.text import entropy

    return {
        "length": size, "entropy": entropy(value), "lower": share("[a-z]"), "upper": share("[A-Z]"), "digits": share("[0-9]"), "symbols": share("[^A-Za-z0-9\\s]"), "blanks": share("\\s"),
        "distinct": F.size(F.array_distinct(chars)), "changes": changes, "longest_run": run, "identifier": is_(r"^[A-Za-z_]\w*$"), "hex": is_(r"^(0x)?[0-9a-fA-F]{16,}$"), "base64": is_(r"^[A-Za-z0-9+/]{16,}={0,2}$"),
        "uuid": is_(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "email": is_(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"), "url": is_(r"^[a-zA-Z][\w+.-]*://"), "url_login": is_(r"://[^/\s:@]+:[^/\s@]+@"), "path": is_(r"^(\.{0,2}/|[A-Za-z]:\\)"),
        "key_prefix": is_(r"^(AKIA|ghp_|gho_|ghs_|sk-|sk_live_|xox[abp]-|glpat-|SG\.|AIza|-----BEGIN)"), "jwt": is_(r"^eyJ[\w-]+\.eyJ"), "placeholder": is_(r"(?i)(change.?me|your|example|placeholder|x{4,}|\*{3,}|<.*>|\$\{)"),
        "words": F.size(F.filter(F.split(value, r"\s+"), lambda w: w != "")),
    }


def echoes(comments: DataFrame, comment_vector: str, context_vector: str, least: float = 0.80) -> DataFrame:
    """Comments whose vector repeats their code's, with ``similarity`` and ``severity``."""
    rows = comments.withColumn("similarity", cosine(F.col(comment_vector), F.col(context_vector))).where(F.col("similarity") >= least)
    return rows.withColumn("severity", tier(F.col("similarity"), (0.95, "critical"), (0.90, "high"), (0.85, "medium")))


def word_vectors(texts: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """``(id, vector)``: unit vectors of hashed words, what stands in for an encoder model that isn't there.

    Texts without words don't come out. Words are hashed once, counted with map-side sums and gathered by id.
    """
    from quarrylens.functions.text import words

    word = texts.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("w"))
    slot = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % dims
    counts = word.groupBy("id", slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return out.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).alias("vector"))


def distribution(rows: DataFrame, column: str = "severity") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def flag_items(parts: dict[str, DataFrame]) -> DataFrame:
    """The findings of several detectors as ``(detector, ...)``, with the columns of all."""
    out = None
    for name, frame in parts.items():
        frame = frame.withColumn("detector", F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    assert out is not None
    return out


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")
