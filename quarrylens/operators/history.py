"""Change history: churn, authors, evolution, blame and differences between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import glob_regex, renamed_path


def once(commits: DataFrame) -> DataFrame:
    """Each change once: rows that differ only in their arrival count once, a file listed twice with other counts twice."""
    return commits.select("commit_hash", "repo", "file", "added", "removed", "author", "ts").distinct()


def path_filter(path: Column, wanted: str) -> Column:
    """A shell pattern, a prefix or a folder."""
    return path.rlike(glob_regex(wanted)) | path.startswith(wanted) | path.startswith(wanted.rstrip("/") + "/")


def churn(commits: DataFrame, min_commits: int = 3, since: str | None = None, until: str | None = None, wanted: str | None = None) -> DataFrame:
    """``(file, commits, added, removed, churn, first_change, last_change)``; binary changes count as commits without lines.

    Renames count for the new path; a date that can't be read is ignored.
    """
    rows = commits.withColumn("file", renamed_path(F.col("file")))
    for text, later in ((since, True), (until, False)):
        if text:
            at = F.try_to_timestamp(F.lit(text))
            rows = rows.where(at.isNull() | (F.col("ts") >= at if later else F.col("ts") <= at))
    if wanted:
        rows = rows.where(path_filter(F.col("file"), wanted))
    out = rows.groupBy("file").agg(
        F.countDistinct("commit_hash").alias("commits"), F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("removed", F.lit(0))).alias("removed"), F.min("ts").alias("first_change"), F.max("ts").alias("last_change")
    )
    return out.where(F.col("commits") >= min_commits).withColumn("churn", F.col("added") + F.col("removed"))


def change_counts(commits: DataFrame) -> DataFrame:
    """``(file, changes)``: rows with line counts, renames under the new path."""
    return commits.where("added is not null and removed is not null").groupBy(renamed_path(F.col("file")).alias("file")).agg(F.count(F.lit(1)).alias("changes"))


def authors(commits: DataFrame, k: int = 5) -> DataFrame:
    """``(file, author, changes, authors, rank)``: the most active authors of each file."""
    rows = commits.where("author is not null").groupBy(renamed_path(F.col("file")).alias("file"), "author").agg(F.count(F.lit(1)).alias("changes"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("changes"), "author"))
    return rows.withColumn("authors", F.count(F.lit(1)).over(Window.partitionBy("file"))).withColumn("rank", rank).where(F.col("rank") <= k)


def evolution(commits: DataFrame, key: str = "file") -> DataFrame:
    """Per key: commits, authors, lines added and removed, the most active author and the whole-number mean of changed lines."""
    rows = commits.groupBy(key, "author").agg(F.countDistinct("commit_hash").alias("c"), F.sum(F.coalesce("added", F.lit(0))).alias("a"), F.sum(F.coalesce("removed", F.lit(0))).alias("r"))
    out = rows.groupBy(key).agg(
        F.sum("c").alias("commits"), F.count("author").alias("authors"), F.sum("a").alias("added"), F.sum("r").alias("removed"),
        F.min_by("author", F.when(F.col("author").isNotNull(), F.struct((-F.col("c")).alias("c"), F.col("author").alias("n")))).alias("most_active"),
    )
    return out.withColumn("mean_change", F.expr("(added + removed) div commits"))


def filtered(commits: DataFrame, author: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits by part of the author's name in any case and by dates; dates that can't be read are ignored."""
    if author:
        commits = commits.where(F.lower("author").contains(author.lower()))
    for text, later in ((since, True), (until, False)):
        if text:
            at = F.try_to_timestamp(F.lit(text))
            commits = commits.where(at.isNull() | (F.col("ts") >= at if later else F.col("ts") <= at))
    return commits


def blame_summary(marks: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(node, commits, newest, oldest)`` of the commits on the lines of ``ranges(node, file, first, last)``.

    ``marks(file, start, upto, commit, time)`` are lines of one commit; a range costs one row, whatever its length.
    """
    held = ranges.join(marks, "file").where("start <= last and upto >= first")
    return held.groupBy("node").agg(F.countDistinct("commit").alias("commits"), F.max_by("commit", F.struct("time", "commit")).alias("newest"), F.min_by("commit", F.struct("time", "commit")).alias("oldest"))


def overlapping_hunks(hunks: DataFrame, first: int, last: int) -> DataFrame:
    """Hunks ``(start, lines)`` that touch a range; an empty hunk touches where it stands."""
    end = F.col("start") + F.greatest(F.col("lines"), F.lit(1)) - 1
    return hunks.where((F.col("start") <= last) & (end >= first))


def differences(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``(key, change)``: added, deleted, modified or unchanged, by a full outer join."""
    a = before.select(key, F.struct(*compared).alias("old"))
    b = after.select(key, F.struct(*compared).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def cached_or_new(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(texts with their cached vector, texts to encode) by the MD5 of model and text."""
    keyed = texts.withColumn("text_md5", F.md5(F.concat(F.lit(model + "\0"), F.col("text"))))
    return keyed.join(cache, "text_md5"), keyed.join(cache, "text_md5", "left_anti")


def dirty(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts whose vector the cache lacks: what a changed index leaves to encode."""
    return cached_or_new(texts, cache, model)[1]
