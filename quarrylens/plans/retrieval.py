"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import retrieval as ops
from quarrylens.operators import store
from quarrylens.plans.bindings import ENTITIES, PAIRS, WORDS, entities, entity_pairs
from quarrylens.session import read_table

QUERY = ["graph", "cache", "refresh", "graph"]
_DOCS = f"docs as (select doc_id as doc, {WORDS} as terms from documents where text is not null), totals as (select count(*) as n, avg(len(terms)) as avg_len from docs)"


def _bm25_sql(terms: list[str]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""with {_DOCS}, q(i, term) as (values {values}),
hits as (select doc, len(terms) as len, i, term, len(list_filter(terms, lambda x: x = term)) as tf from docs, q where list_contains(terms, term)),
df as (select term, count(distinct doc) as df from hits group by term)
select doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) as score from hits join df using (term), totals group by doc"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").where("text is not null")


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """From the stored index of the documents, built by the first search."""
    index = store.text_index(read_table(spark, sf, "documents"), "doc_id", "text")
    found = store.search(spark, index, QUERY).select("doc", F.round("score", 6).alias("score"))
    return ops.top(found, 20, [F.desc("score"), F.col("doc")])


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ops.bm25(_documents(spark, sf), "doc_id", "text", QUERY, repeats=True).select("doc", F.round("score", 6).alias("score"))


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return ops.term_stats(ops.postings(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return ops.doc_stats(ops.postings(_documents(spark, sf), "doc_id", "text"))


def static_idf(spark: SparkSession, sf: str) -> DataFrame:
    return ops.static_idf(_documents(spark, sf), "doc_id", "text").select("doc", F.round("score", 4).alias("score"))


def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 100 asks all rows."""
    rows = read_table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = ops.semantic(rows, "vec_id", "embedding", asked).where("query <> id").select("query", "id", F.round("cosine", 6).alias("cosine"))
    return ops.top(found, 10, [F.desc("cosine"), F.col("id")], ["query"])


def find_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return ops.find_identifiers(entities(spark, sf), "node", "name", "merge", "file")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("bm25"), F.max("l_quantity").alias("pr"), F.countDistinct("l_returnflag").cast("double").alias("bt"))
    return rows.unpivot("node", ["bm25", "pr", "bt"], "signal", "score")


_SIGNALS = """signals as (unpivot (select l_suppkey as node, cast(count(*) as double) as bm25, max(l_quantity) as pr, cast(count(distinct l_returnflag) as double) as bt from lineitem group by 1) on bm25, pr, bt into name signal value score)"""
_RANKED = _SIGNALS + ", ranked as (select node, signal, rank() over (partition by signal order by score desc) - 1 as r, case signal when 'bm25' then 4.0::double when 'pr' then 0.5::double else 0.5::double end as w from signals)"


def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return ops.fuse(_signals(spark, sf), ops.SIGNALS["query_bm25"]).select("node", F.round("score", 8).alias("score"))


def rank_fusion_penalised(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = read_table(spark, sf, "supplier")
    private, test = F.col("s_nationkey") % 3 == 0, F.col("s_nationkey") % 5 == 0
    penalties = suppliers.select(F.col("s_suppkey").alias("node"), (F.when(private, 20).otherwise(0) + F.when(test, 10).otherwise(0)).alias("penalty"))
    weak = suppliers.where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return ops.fuse(_signals(spark, sf), ops.SIGNALS["query_bm25"], penalties, weak).select("node", F.round("score", 8).alias("score"))


def class_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are methods of their nation."""
    scores = _signals(spark, sf).withColumn("node", F.concat(F.lit("s"), F.col("node"))).where("signal <> 'bm25'")
    members = read_table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return ops.roll_up(scores, members).select("signal", "node", F.round("score", 6).alias("score"))


def _map(spark: SparkSession, sf: str, blamed: bool = True, classes: bool = False) -> DataFrame:
    from quarrylens.plans.quality import _marks

    spans = entities(spark, sf).where("lines is not null").select("node", "file", "first", (F.col("first") + F.col("lines") - 1).alias("last"))
    members = spans.select("node", F.col("file").alias("parent")) if classes else None
    return ops.simple_map(spans, _marks(spark, sf) if blamed else None, members).select("node", F.round("score", 6).alias("score"))


def simple_map(spark: SparkSession, sf: str) -> DataFrame:
    """Entities span their lines; a commit touches as many of a file's lines as it added."""
    return _map(spark, sf)


def simple_map_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Without any blame the number of lines ranks."""
    return _map(spark, sf, blamed=False)


def simple_map_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Files stand for the classes of their entities."""
    return _map(spark, sf, classes=True)


def budget_stop(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", "source", fx.token_estimate(F.col("text"), 4.0).alias("tokens"))
    return ops.budget_stop(rows, [F.desc("tokens"), F.col("doc_id")], F.col("tokens"), 4000, ["source"]).select("source", "doc_id", "tokens", "used")


def budget_skip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).where("repo is not null").select("doc_id", "repo", fx.token_estimate(F.col("text"), 4.0).alias("tokens"))
    return ops.budget_skip(rows, "repo", F.col("doc_id"), "doc_id", "tokens", 1000)


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).withColumn("language", fx.language_of(F.col("file")))
    return rows.groupBy("kind", "language").agg(F.count(F.lit(1)).alias("entities"), F.sum("lines").alias("lines"))


def entity_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Names as the ranking sees them: private, test, utility, tiny, module and token estimate."""
    rows = entities(spark, sf)
    language = fx.language_of(F.col("file"))
    return rows.select(
        "node", language.alias("language"), fx.is_private(F.col("name"), language).alias("private"), fx.is_test(F.col("name"), F.col("file")).alias("test"), fx.is_utility(F.col("name")).alias("utility"),
        (F.coalesce("lines", F.lit(0)) < 5).alias("tiny"), fx.module_of(F.col("file")).alias("module"), fx.base_name(F.col("file")).alias("base"),
    )


def pair_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose names are equal, and those nested in one file."""
    from quarrylens.operators.clones import nested

    rows = entity_pairs(spark, sf).where("lines_a is not null and lines_b is not null")
    last_a, last_b = F.col("first_a") + F.col("lines_a") - 1, F.col("first_b") + F.col("lines_b") - 1
    return rows.select("pair_id", (F.col("name_a") == F.col("name_b")).alias("same_name"), nested(F.col("file_a"), F.col("first_a"), last_a, F.col("file_b"), F.col("first_b"), last_b).alias("nested"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_scores, bm25_terms, bm25_lengths, static_idf, semantic_search, find_identifiers, rank_fusion, rank_fusion_penalised, class_rollup, simple_map, simple_map_lines, simple_map_rollup, budget_stop, budget_skip, index_stats, entity_flags, pair_names)}

_LANG = "case regexp_extract(file, '\\.([^./]+)$', 1) when 'py' then 'python' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'mjs' then 'javascript' when 'cjs' then 'javascript' when 'go' then 'go' when 'java' then 'java' when 'c' then 'c' when 'sh' then 'bash' end"
_SCORED = "select term, df, round(ln(((select count(*) from documents where text is not null) - df + 0.5) / (df + 0.5) + 1), 6) as idf from df"
_ROLL = """with signals0 as (select 's' || node as node, signal, score from (unpivot (select l_suppkey as node, max(l_quantity) as pr, cast(count(distinct l_returnflag) as double) as bt from lineitem group by 1) on pr, bt into name signal value score)),
inner_ as (select signal, 'n' || s_nationkey as node, case signal when 'pr' then sqrt(sum(score)) else max(score) + sum(score) end as added from signals0 join supplier on node = 's' || s_suppkey group by 1, 2)
select coalesce(s.signal, i.signal) as signal, coalesce(s.node, i.node) as node, round(coalesce(score, 0) + 0.3 * coalesce(added, 0), 6) as score from signals0 s full join inner_ i on s.signal = i.signal and s.node = i.node"""
_FUSED = "select node, round(sum(w / (30 + r)), 8) as score from ranked group by node"

SQL = {
    "bm25_search": f"select doc, score, cast(row_number() over (order by score desc, doc) as int) as rank from ({_bm25_sql(list(dict.fromkeys(QUERY)))}) order by score desc, doc limit 20",
    "bm25_scores": _bm25_sql(QUERY),
    "bm25_terms": f"with {_DOCS}, df as (select term, count(*) as df from (select doc, unnest(list_distinct(terms)) as term from docs) group by term) {_SCORED}",
    "bm25_lengths": f"with {_DOCS} select doc, cast(len(terms) as bigint) as terms from docs where len(terms) > 0",
    "static_idf": f"with {_DOCS}, t as (select doc, unnest(list_distinct(terms)) as term from docs), df as (select term, count(*) as df from t group by term) select doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)), 4) as score from t join df using (term), totals group by doc",
    "semantic_search": """with s as (select a.vec_id as query, b.vec_id as id, round(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: z[1] * z[2])), 6) as cosine, list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: z[1] * z[2])) as raw
from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0), r as (select query, id, cosine, cast(row_number() over (partition by query order by cosine desc, id) as int) as rank from s where raw > 0.1) select * from r where rank <= 10""",
    "find_identifiers": f"with {ENTITIES} select node as id, name, case when lower(name) = 'merge' then 100 when starts_with(lower(name), 'merge') then 75 when contains(lower(name), 'merge') then 50 else 25 end as score from entities where contains(lower(name), 'merge') or contains(lower(file), 'merge')",
    "rank_fusion": f"with {_RANKED} {_FUSED}",
    "rank_fusion_penalised": f"with {_RANKED}, p as (select s_suppkey as node, case when s_nationkey % 3 = 0 then 20 else 0 end + case when s_nationkey % 5 = 0 then 10 else 0 end as penalty, s_acctbal < 0 as weak from supplier) select node, round(sum(w / (30 + r + penalty)) * case when any_value(weak) then 0.4 else 1 end, 8) as score from ranked join p using (node) group by node",
    "class_rollup": _ROLL,
    "budget_stop": "with t as (select source, doc_id, greatest(1, cast(floor(length(text) / 4.0) as int)) as tokens from documents where text is not null), u as (select *, sum(tokens) over (partition by source order by tokens desc, doc_id rows unbounded preceding) as used from t) select source, doc_id, tokens, cast(used as bigint) as used from u where used <= 4000",
    "budget_skip": "with t as (select repo, doc_id as id, greatest(1, cast(floor(length(text) / 4.0) as int)) as t from documents where text is not null and repo is not null), g as (select repo, list({'id': id, 'u': t, 'kept': true} order by id) as l from t group by repo), f as (select repo, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: case when list_sum(list_transform(a, lambda y: y.u)) + b[1].u <= 1000 then list_concat(a, b) else a end, [{'id': cast(-1 as bigint), 'u': 0, 'kept': true}]) as k from g), o as (select repo, unnest(k) as x, generate_subscripts(k, 1) as i, k from f) select repo, x.id as id, cast(list_sum(list_transform(k[1:i], lambda y: y.u)) as bigint) as used from o where x.id >= 0",
    "index_stats": f"with {ENTITIES} select kind, {_LANG} as language, count(*) as entities, cast(sum(lines) as bigint) as lines from entities group by 1, 2",
    "entity_flags": f"with {ENTITIES}, e as (select *, {_LANG} as language, lower(regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '')) as stem, string_split(file, '/') as parts from entities) select node, language, case when language = 'go' then regexp_matches(name[1], '[a-z]') when language = 'javascript' then regexp_matches(name, '^[_#]') when language = 'python' then starts_with(name, '_') and not starts_with(name, '__') else starts_with(name, '_') end as private, regexp_matches(lower(name), '^(test|spec)|(test|spec)$') or regexp_matches(stem, '^(test_|spec_)|(_test|_spec)$') as test, lower(name) in ({', '.join(repr(x) for x in fx.UTILITIES)}) as utility, coalesce(lines, 0) < 5 as tiny, case when list_position(parts, 'src') > 0 and len(parts) > list_position(parts, 'src') + 1 then parts[list_position(parts, 'src') + 1] when len(parts) > 1 then parts[1] else 'root' end as module, parts[-1] as base from e",
    "pair_names": f"with {PAIRS} select pair_id, name_a = name_b as same_name, file_a = file_b and ((first_a <= first_b and first_a + lines_a >= first_b + lines_b) or (first_b <= first_a and first_b + lines_b >= first_a + lines_a)) as nested from pairs where lines_a is not null and lines_b is not null",
}
