"""The reference notions (entities, edges, commits, ...) bound to the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import read_table


def posix(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"^(?:\./)+", "")


def posix_sql(path: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({path}, '\', '/'), '/+', '/', 'g'), '^(?:\./)+', '')"


def entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Clone pairs once: pair_id, both entities' node, file, name, kind and lines, and the similarity in 0..1."""
    rows = read_table(spark, sf, "clone").where("entity1.file is not null and entity2.file is not null").dropDuplicates(["pair_id"])
    out = rows
    for e, s in (("entity1", "a"), ("entity2", "b")):
        file = posix(F.col(f"{e}.file"))
        out = out.withColumn(f"file_{s}", file).withColumn(s, F.concat_ws("::", file, F.col(f"{e}.name"), F.col(f"{e}.line").cast("string")))
        out = out.withColumn(f"name_{s}", F.col(f"{e}.name")).withColumn(f"kind_{s}", F.col(f"{e}.type")).withColumn(f"lines_{s}", F.col(f"{e}.lines")).withColumn(f"first_{s}", F.col(f"{e}.line"))
    names = [f"{x}_{s}" for s in "ab" for x in ("file", "name", "kind", "lines", "first")]
    return out.select("pair_id", "a", "b", *names)


PAIRS = f"""pairs as (select pair_id, file_a, file_b, file_a || '::' || name_a || '::' || first_a as a, file_b || '::' || name_b || '::' || first_b as b, name_a, name_b, kind_a, kind_b, lines_a, lines_b, first_a, first_b from (
  select pair_id, {posix_sql('any_value(entity1).file')} as file_a, {posix_sql('any_value(entity2).file')} as file_b, any_value(entity1).name as name_a, any_value(entity2).name as name_b, any_value(entity1).type as kind_a,
    any_value(entity2).type as kind_b, any_value(entity1).lines as lines_a, any_value(entity2).lines as lines_b, any_value(entity1).line as first_a, any_value(entity2).line as first_b
  from clone where entity1.file is not null and entity2.file is not null group by pair_id))"""


def entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``(src, dst, weight)`` between entities: the number of pairs."""
    rows = entity_pairs(spark, sf).where("a <> b")
    return rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


ENTITY_EDGES = PAIRS + ", edges as (select a as src, b as dst, cast(count(*) as double) as weight from pairs where a <> b group by a, b)"


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """``(node, file, name, kind, lines, first)`` of every paired entity."""
    rows = entity_pairs(spark, sf)
    both = rows.select(F.explode(F.array(*[F.struct(F.col(s).alias("node"), *[F.col(f"{x}_{s}").alias(x) for x in ("file", "name", "kind", "lines", "first")]) for s in "ab"])).alias("e")).select("e.*")
    return both.groupBy("node", "file", "name", "first").agg(F.max("kind").alias("kind"), F.max("lines").alias("lines"))


ENTITIES = PAIRS + """, ends as (select a as node, file_a as file, name_a as name, first_a as first, kind_a as kind, lines_a as lines from pairs union all select b, file_b, name_b, first_b, kind_b, lines_b from pairs),
entities as (select node, file, name, first, max(kind) as kind, max(lines) as lines from ends group by node, file, name, first)"""


def repo_edges(spark: SparkSession, sf: str, least: float = 1.0) -> DataFrame:
    """``(src, dst, weight)`` between repositories: the number of clone pairs."""
    rows = entity_pairs(spark, sf).select(F.split_part("file_a", F.lit("/"), F.lit(1)).alias("src"), F.split_part("file_b", F.lit("/"), F.lit(1)).alias("dst"))
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).where(F.col("weight") >= least)


def repo_edges_sql(least: int = 1) -> str:
    return PAIRS + f", edges as (select split_part(file_a, '/', 1) as src, split_part(file_b, '/', 1) as dst, cast(count(*) as double) as weight from pairs group by 1, 2 having split_part(file_a, '/', 1) <> split_part(file_b, '/', 1) and count(*) >= {least})"


NODES = ", nodes as (select distinct unnest([src, dst]) as node from edges)"
WORDS = r"list_filter(string_split_regex(regexp_replace(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]', ' ', 'g'), ' +'), lambda t: length(t) >= 2)"


def commits(spark: SparkSession, sf: str) -> DataFrame:
    from quarrylens.operators.history import once

    return once(read_table(spark, sf, "commit_files"))


COMMITS = r"""commits as (select commit_hash, regexp_replace(regexp_replace(regexp_replace(file, '\{([^{}]*) => ([^{}]*)\}', '\2', 'g'), '^.* => ', ''), '/+', '/', 'g') as file, added, removed, author, ts from (
  select distinct commit_hash, repo, file, added, removed, author, ts from commit_files))"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    from quarrylens.operators.audit import newest

    return newest(read_table(spark, sf, "file_analysis"))


FILES = "files as (select * from (select *, row_number() over (partition by file_id order by ingested_at desc nulls last) as n from file_analysis) where n = 1)"
