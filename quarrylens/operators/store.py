"""A stored index: postings by bucket of their term, reused as long as the texts it was built from are the same."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import words
from quarrylens.operators.retrieval import B, K1
from quarrylens.session import cut, shared_folder

#: Folders of terms; a search reads those of its terms only. An index of another layout isn't read.
BUCKETS, LAYOUT = 256, "2"


def bucket(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % BUCKETS


def signature(rows: DataFrame, *parts: str) -> str:
    """What the files below ``rows`` are: their paths, sizes and times, and how they are read."""
    known = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    total = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return hashlib.md5(json.dumps([str(total[0]), str(total[1]), *parts]).encode()).hexdigest()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What an artifact says of itself, or None if there is none or it was not finished: the manifest is written last."""
    try:
        return json.loads(spark.read.text(f"{folder}/manifest").first().value)
    except Exception:  # noqa: BLE001  no such folder, or an unfinished one
        return None


def save(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str]]], facts: dict) -> None:
    """Tables (with their partitioning), then the manifest that makes them valid."""
    for name, (rows, by) in tables.items():
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def text_index(docs: DataFrame, id_col: str, text_col: str) -> str:
    """The folder of an index of ``docs``, built unless there is one of the same files. Null texts aren't indexed.

    Each posting carries its document's length and its term's frequency, so that a search needs no other table.
    """
    spark = docs.sparkSession
    key = signature(docs, id_col, text_col, LAYOUT, str(BUCKETS))
    folder = f"{shared_folder(spark)}/index-{key}"
    if manifest(spark, folder):
        return folder
    terms = words(F.col(text_col))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), terms.alias("terms"), F.size(terms).alias("len"))
    counts = rows.select("doc", "len", F.explode("terms").alias("term")).groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    slot = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % BUCKETS
    postings = cut(counts.join(df, "term").withColumn("bucket", slot.cast("int")).select("term", "doc", "len", "tf", "df", "bucket"))
    total = rows.agg(F.count(F.lit(1)), F.avg(F.col("len").cast("double"))).first()
    postings = postings.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
    kind = docs.schema[id_col].dataType.simpleString()
    filled = sorted(r.bucket for r in postings.select("bucket").distinct().collect())  # 256 at most
    save(spark, folder, {"postings": (postings, ["bucket"])}, {"docs": total[0], "avg_len": total[1] or 0.0, "id": kind, "buckets": filled})
    return folder


def search(spark: SparkSession, folder: str, query: list[str], repeats: bool = False) -> DataFrame:
    """``(doc, score)`` by BM25 from a stored index: the postings of the query's terms are all that is read."""
    facts = manifest(spark, folder)
    if facts is None:
        raise ValueError(f"no index in {folder}")
    uses = {t: query.count(t) if repeats else 1 for t in query}
    wanted = sorted({bucket(t) for t in uses} & set(facts["buckets"]))
    if not wanted:
        return spark.createDataFrame([], f"doc {facts['id']}, score double")
    rows = spark.read.schema(f"term string, doc {facts['id']}, len int, tf bigint, df bigint").parquet(*[f"{folder}/postings/bucket={k}" for k in wanted])
    rows = rows.where(F.col("term").isin(sorted(uses)))
    times = F.try_element_at(F.create_map(*[F.lit(x) for pair in uses.items() for x in pair]), F.col("term"))
    idf = F.log((F.lit(float(facts["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / facts["avg_len"]))
    return rows.groupBy("doc").agg(F.sum(times * idf * weight).alias("score")).where("score <> 0")
