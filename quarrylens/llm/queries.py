"""The queries of this package and their equivalents in SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe, groups, mixing, neighbours, provenance, secrets, syntax, truncation
from quarrylens.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.credentials(read_table(spark, sf, "sensitive_value")).select("value_id").distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.credentials(read_table(spark, sf, "sensitive_value"))
    return found.select("value_id", F.size("secrets").alias("secrets"), F.col("redacted").alias("context_text"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.clone_groups(read_table(spark, sf, "clone"))


def p2_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("nodes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(read_table(spark, sf, "cached_indices"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_files(read_table(spark, sf, "file_analysis"))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_rates(read_table(spark, sf, "file_analysis"), ["repo"])


def p4_package_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_rates(read_table(spark, sf, "file_analysis"), ["repo", "package"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_handwritten(read_table(spark, sf, "file_analysis"))


def p5_origins(spark: SparkSession, sf: str) -> DataFrame:
    files = read_table(spark, sf, "file_analysis")
    found = provenance.file_origins(files).groupBy("id").agg(F.min("origin").alias("origin"))
    once = files.groupBy(F.col("file_id").alias("id")).agg(F.min("repo").alias("repo"), F.max("loc").alias("loc"))
    out = once.join(found, "id").groupBy("repo", F.coalesce("origin", F.lit("handwritten")).alias("origin"))
    return out.agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(read_table(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose decoded ids are their text (null counts as empty)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    back = bpe.decode_corpus(bpe.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    both = docs.join(back, "doc_id")
    return both.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_copies(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_shares(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_documents(read_table(spark, sf, "documents"))


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.field_limits(read_table(spark, sf, "documents"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(read_table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p2_found, p2_sizes, p3_found, p4_found, p4_rates, p4_package_rates, p5_found, p5_origins, p6_ids, p6_roundtrip, p7_mix, p7_shares, p8_found, p8_limits, p8_rates)
}

_GROUPS = r"""
with recursive rows as (
  select e, s from (select case when entity1.name is not null and entity1.file is not null and entity1.line is not null then
      regexp_replace(regexp_replace(replace(entity1.file, '\', '/'), '/+', '/', 'g'), '^(?:\./)+', '') || '::' || entity1.name || '::' || cast(entity1.line as bigint) end as a,
    case when entity2.name is not null and entity2.file is not null and entity2.line is not null then
      regexp_replace(regexp_replace(replace(entity2.file, '\', '/'), '/+', '/', 'g'), '^(?:\./)+', '') || '::' || entity2.name || '::' || cast(entity2.line as bigint) end as b,
    similarity as x from clone) t, lateral (select [a, b] as e, case when isnan(x) or x < 0 then null when x > 1 then x / 100.0 else x end as s) l),
nodes as (select distinct unnest(e) as n from rows),
edges as (select distinct e[1] as a, e[2] as b from rows where s >= 0.85 and s <= 1 and e[1] is not null and e[2] is not null and e[1] <> e[2]),
both_ways as (select a, b from edges union select b, a from edges),
reach(n, g) using key (n) as (
  select n, n from nodes where n is not null
  union
  select w.b, min(r.g) from reach r join both_ways w on w.a = r.n join recurring.reach q on q.n = w.b where r.g < q.g group by w.b)
select n as node_id, g as group_id from reach"""

def _count(*marks: str) -> str:
    return " + ".join(f"(length(text) - length(replace(text, {m}, '')))" for m in marks)


_FEEDS, _PAIRS = _count("chr(10)"), "((length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2)"
_HTML, _QUOTES = f"(4 * ({_count(chr(39) + '&' + chr(39))}) + 3 * ({_count(chr(39) + '<' + chr(39), chr(39) + '>' + chr(39))}))", f"(5 * ({_count('chr(34)', 'chr(39)')}))"
_JSON = f"({_count('chr(34)', 'chr(92)', 'chr(10)', 'chr(13)', 'chr(9)', 'chr(12)', 'chr(8)')})"
_ASTRAL, _BEYOND = r"(length(text) - length(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '', 'g')))", r"(length(text) - length(regexp_replace(text, '[^\x{0}-\x{7F}]', '', 'g')))"
_SIZES = {
    "characters": "length(text)", "bytes": "strlen(text)", "utf16": f"length(text) + {_ASTRAL}", "html": f"length(text) + {_HTML}", "html_quotes": f"length(text) + {_HTML} + {_QUOTES}", "html_bytes": f"strlen(text) + {_HTML} + {_QUOTES}",
    "json": f"length(text) + {_JSON}", "json_ascii": f"length(text) + {_JSON} + 5 * {_BEYOND} + 6 * {_ASTRAL}", "json_bytes": f"strlen(text) + {_JSON}", "crlf": f"length(text) + ({_FEEDS}) - {_PAIRS}", "lf": f"length(text) - {_PAIRS}", "lf_bytes": f"strlen(text) - {_PAIRS}",
}
_LIMITS = rf"""
with t as (select distinct coalesce(regexp_replace(lower(trim(source, ' ')), '[\s_\-]+', '_', 'g'), '') as source, text from documents where regexp_matches(text, '\S')),
s as ({' union all '.join(f"select source, '{k}' as measure, cast({v} as bigint) as length from t" for k, v in _SIZES.items())}),
c as (select source, measure, length, count(*) as texts from s group by all),
m as (select *, (sum(texts) over wide - texts) / (16 + least(16, length - 1))::double as far, (sum(texts) over close - texts) / (2 + least(2, length - 1))::double as near from c
  window wide as (partition by source, measure order by length range between 16 preceding and 16 following), close as (partition by source, measure order by length range between 2 preceding and 2 following)),
e as (select *, greatest(far, near) as expected from m)
select source, measure, cast(length as int) as length, texts, expected from e where texts > expected + 4 * sqrt(expected) + 3 and expected <= 0.5 * texts"""

SQL: dict[str, str] = {
    "p2_found": _GROUPS,
    "p2_sizes": f"select group_id, count(*) as nodes from ({_GROUPS}) group by group_id",
    "p8_limits": _LIMITS,
    "p6_roundtrip": "select doc_id, true as same from documents",
    "p3_found": """
with ranked as (select *, row_number() over (partition by node_id order by cached_at desc nulls last, ingested_at desc nulls last) as n from cached_indices where node_id is not null),
good as (select node_id, embedding::double[384] as v from ranked where n = 1 and len(embedding) = 384 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select node_id, list_transform(v::double[], lambda x: x / sqrt(list_sum(list_transform(v::double[], lambda y: y * y))))::double[384] as u from good),
pairs as (select a.node_id as x, b.node_id as y, array_inner_product(a.u, b.u) as s from unit a join unit b on a.node_id <> b.node_id),
best as (select x, y, row_number() over (partition by x order by round(s, 6) desc, y) as n from pairs)
select distinct least(x, y) as node_a, greatest(x, y) as node_b from best where n <= 5""",
}
