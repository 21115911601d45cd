"""Package structure: import edges, cycles and five rules on packages and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.graph import cycles


def newest(files: DataFrame, key: str = "file_id", order: str = "ingested_at") -> DataFrame:
    """One row a file: the last to arrive."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))
    return files.withColumn("n", rank).where("n = 1").drop("n")


def package_imports(files: DataFrame) -> DataFrame:
    """``(src, dst, imports)`` between different packages, in-function imports included."""
    both = F.concat(F.transform("imports", lambda x: x["target_package"]), F.transform("in_function_imports", lambda x: x["target_package"]))
    rows = files.where("package is not null").select(F.col("package").alias("src"), F.explode(both).alias("dst"))
    return rows.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("imports"))


def resolve_packages(modules: DataFrame, packages: DataFrame, separator: str = ".") -> DataFrame:
    """``(module, package)``: the longest registered prefix of each module.

    All prefixes are exploded and equi-joined, so no module meets every package.
    """
    parts = F.split("module", F.lit("\\" + separator if separator in (".", "\\") else separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    rows = modules.select("module").distinct().select("module", F.explode(prefixes).alias("package")).join(packages.select("package").distinct(), "package")
    return rows.groupBy("module").agg(F.max_by("package", F.length("package")).alias("package"))


def enclosing_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``(file, package)``: the deepest package folder above each file; ``packages(folder, package)``."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select("file").distinct().select("file", F.explode(above).alias("folder")).join(packages, "folder")
    return rows.groupBy("file").agg(F.max_by("package", F.length("folder")).alias("package"))


def package_metrics(files: DataFrame, facades: DataFrame | None = None) -> DataFrame:
    """``(package, files, loc, fan_out, interface, ratio)``; interface: public symbols and parameters, 1 at least."""
    known = files.where("package is not null")
    base = known.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"))
    out = package_imports(known).groupBy(F.col("src").alias("package")).agg(F.count(F.lit(1)).alias("fan_out"))
    rows = base.join(out, "package", "left").fillna(0, ["fan_out"])
    if facades is None:
        # without facades the names others import stand for the interface
        asked = known.select(F.explode("imports").alias("i")).select(F.col("i.target_package").alias("package"), F.col("i.target_module").alias("m")).where("package is not null")
        facades = asked.groupBy("package").agg(F.countDistinct("m").alias("interface"))
    else:
        facades = facades.select("package", (F.size("public_symbols") + F.col("public_params")).alias("interface"))
    rows = rows.join(facades, "package", "left").withColumn("interface", F.greatest(F.lit(1).cast("bigint"), F.coalesce("interface", F.lit(0))))
    return rows.withColumn("ratio", F.round(F.col("loc") / F.col("interface"), 2))


def kitchen_sinks(metrics: DataFrame, loc: int = 5000, files: int = 30, fan_out: int = 6) -> DataFrame:
    return metrics.where(((F.col("loc") > loc) | (F.col("files") > files)) & (F.col("fan_out") > fan_out))


def shallow_packages(metrics: DataFrame, ratio: float = 200, loc: int = 300) -> DataFrame:
    return metrics.where((F.col("ratio") < ratio) & (F.col("loc") >= loc))


def oversized_files(files: DataFrame, loc: int = 665, some: int = 500, imports: int = 15) -> DataFrame:
    return files.where((F.col("loc") > loc) | ((F.col("loc") > some) & (F.col("top_import_statements") > imports)))


def function_imports(files: DataFrame, top: int = 3) -> DataFrame:
    """``(package, total, top_imports, elsewhere)``: imports inside functions, those to the three most frequent targets and the rest."""
    rows = files.where("package is not null").select("package", F.explode("in_function_imports").alias("i"))
    counts = rows.groupBy("package", F.coalesce("i.target_package", F.lit("?")).alias("target")).agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("c"), "target"))
    out = counts.withColumn("n", rank).groupBy("package")
    return out.agg(F.sum("c").alias("total"), F.sum(F.when(F.col("n") <= top, F.col("c")).otherwise(0)).alias("top_imports"), F.sum(F.when(F.col("n") > top, F.col("c")).otherwise(0)).alias("elsewhere"))


def package_cycles(imports: DataFrame) -> DataFrame:
    """``(cycle, packages, members)`` of import cycles, named by their smallest package."""
    found = cycles(imports)
    return found.groupBy("cycle").agg(F.count(F.lit(1)).alias("packages"), F.sort_array(F.collect_list("node")).alias("members")).where("packages > 1")


def cycle_imports(imports: DataFrame) -> DataFrame:
    """Imports with both ends in the same cycle."""
    found = cycles(imports)
    a, b = found.toDF("src", "ca"), found.toDF("dst", "cb")
    return imports.join(a, "src").join(b, "dst").where("ca = cb").drop("cb").withColumnRenamed("ca", "cycle")


def findings(files: DataFrame, imports: DataFrame, metrics: DataFrame, top: int | None = 10, limits: dict[str, float] | None = None) -> DataFrame:
    """``(rule, subject, size, rank)``: the audit's rules, each with its own order and its first ``top`` rows (all for 0 or None).

    ``files(file, loc, top_import_statements)``, ``imports(src, dst, inside)``, ``metrics`` of ``package_metrics``.
    """
    limit = {"loc": 5000, "files": 30, "fan_out": 6, "ratio": 200, "least": 300, "lines": 665, "some": 500, "imports": 15} | (limits or {})
    found = package_cycles(imports.where("not inside").select("src", "dst").distinct())
    parts = {
        "cycle": found.select(F.array_join("members", ",").alias("subject"), F.col("packages").cast("double").alias("size")),
        "kitchen_sink": kitchen_sinks(metrics, limit["loc"], limit["files"], limit["fan_out"]).select(F.col("package").alias("subject"), F.col("loc").cast("double").alias("size")),
        "shallow_package": shallow_packages(metrics, limit["ratio"], limit["least"]).select(F.col("package").alias("subject"), (-F.col("ratio")).alias("size")),
        "oversized_file": oversized_files(files, limit["lines"], limit["some"], limit["imports"]).select(F.col("file").alias("subject"), F.col("loc").cast("double").alias("size")),
        "function_imports": imports.where("inside").groupBy(F.col("src").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("size")),
    }
    out = None
    for rule, rows in parts.items():
        rows = rows.select(F.lit(rule).alias("rule"), "subject", "size")
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("size"), "subject"))
    ranked = out.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= top) if top else ranked


def report(rows: DataFrame) -> DataFrame:
    """``(rule, value)``: the findings of each rule as one JSON text; the rules are few and each has its first rows only."""
    listed = rows.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("rank", "subject", "size"))).alias("findings"))
    return listed.select("rule", F.to_json(F.struct("rule", "findings")).alias("value"))
