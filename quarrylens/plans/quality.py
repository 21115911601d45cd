"""Queries of the detectors, the package audit, change history, sources, streams and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as fx
from quarrylens.operators import audit, clones, detectors, history
from quarrylens.plans.bindings import COMMITS, ENTITIES, FILES, PAIRS, commits, entities, entity_edges, entity_pairs, files, repo_edges, repo_edges_sql
from quarrylens.operators.retrieval import top
from quarrylens.sinks import formats
from quarrylens.sources import logs, tree
from quarrylens.session import read_table
from quarrylens.streaming import changes


# ---------------------------------------------------------------------------------------------------- detectors


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    language = fx.language_of(F.col("file"))
    return entities(spark, sf).where("kind is not null and lines is not null").select(
        "node", "name", "kind", "lines", fx.is_test(F.col("name"), F.col("file")).alias("test"), fx.is_private(F.col("name"), language).alias("private"), (F.col("first") % 7 == 0).alias("decorated"), F.lit(None).cast("string").alias("parent")
    )


def dead_code(spark: SparkSession, sf: str) -> DataFrame:
    used = read_table(spark, sf, "sensitive_value").where("variable_name is not null").select(F.col("variable_name").alias("name"))
    return detectors.unreferenced(_candidates(spark, sf), entity_edges(spark, sf), used, least=0.1)


def _params(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").join(read_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("node"), F.col("p_brand").alias("param"))


def tramp_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.parameter_pairs(_params(spark, sf), 100)


def tramp_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of parameters that three functions or more take, from the files' syntax trees."""
    found = detectors.parameter_groups(function_params(files(spark, sf)), 3)
    return spark.createDataFrame([(",".join(g), n) for g, n in found], "members string, functions bigint")


def function_params(rows: DataFrame) -> DataFrame:
    """``(node, param)`` of the functions of source files."""
    found = tree.facts(rows).where("fact = 'param'")
    return found.select(F.concat_ws("::", "file", "parent", F.col("line").cast("string")).alias("node"), F.col("name").alias("param"))


def _literals(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)
    return read_table(spark, sf, "documents").where("text is not null").select(F.col("source").alias("file"), F.explode(found).alias("value"))


def magic_constants(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.magic_constants(_literals(spark, sf), kind="numeric")


def sensitive_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sensitive_value").dropDuplicates(["value_id"])
    return detectors.scored_values(rows, "original_value", "confidence").select("value_id", "value_preview", "severity")


def sensitive_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.distribution(sensitive_scores(spark, sf))


def string_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sensitive_value").where("original_value is not null").dropDuplicates(["value_id"])
    out = rows.select("value_id", *[v.alias(k) for k, v in detectors.string_features(F.col("original_value")).items()])
    return out.select("value_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in out.dtypes if c != "value_id"])


def echo_comments(spark: SparkSession, sf: str) -> DataFrame:
    """A text's title stands for a comment, each line of its text for code; the line most like the title counts."""
    rows = read_table(spark, sf, "documents").where("title is not null and text is not null")
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    title = detectors.word_vectors(rows.select("doc_id", "title"), "doc_id", "title").toDF("doc_id", "c")
    keyed = lines.select(F.struct("doc_id", "pos").alias("key"), "line")
    code = detectors.word_vectors(keyed, "key", "line").select("id.doc_id", "id.pos", F.col("vector").alias("t"))
    found = detectors.echoes(title.join(code, "doc_id"), "c", "t", 0.5).groupBy("doc_id")
    best = found.agg(F.max("similarity").alias("similarity"), F.max_by("severity", "similarity").alias("severity"))
    return best.select("doc_id", F.round("similarity", 6).alias("similarity"), "severity")


def clone_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").where("text is not null")
    return clones.candidates(clones.function_lines(docs, "doc_id", "text"))


def clones_syntactic(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").where("text is not null")
    return clones.syntactic(docs, "doc_id", "text").withColumn("share", F.round("share", 6))


def clones_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of different vectors, across labels."""
    return clones.similar_vectors(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 0.35).withColumn("similarity", F.round("similarity", 6))


def clones_combined(spark: SparkSession, sf: str) -> DataFrame:
    """The table's own vector and line scores, recombined; of repeated pairs the highest counts."""
    rows = read_table(spark, sf, "clone").where("semantic_sim is not null and not isnan(semantic_sim)").dropDuplicates(["pair_id"])
    s, y, b = F.col("semantic_sim"), F.col("syntactic_pct"), F.col("max_block_size")
    out = rows.select("pair_id", F.round(clones.combined_score(s, y, b), 6).alias("score"), clones.combined_category(s, y, b).alias("category"))
    return out


def clone_actions(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "clone").where("not coalesce(isnan(semantic_sim), false)").dropDuplicates(["pair_id"])
    s, y, b = F.col("semantic_sim"), F.col("syntactic_pct"), F.col("max_block_size")
    out = rows.select("pair_id", s, y, clones.combined_score(s, y, b).alias("score")).join(entity_pairs(spark, sf), "pair_id")
    names = [F.col(x) for x in ("name_a", "name_b", "file_a", "file_b", "score", "semantic_sim", "syntactic_pct")]
    return out.select("pair_id", clones.suggested_action(*names).alias("action"))


def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.split_part("action", F.lit(":"), F.lit(1))
    return clone_actions(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pairs"))


def clones_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty pairs by category, score and id."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(clones.CATEGORIES) for x in (c, i)])
    rows = clones_combined(spark, sf).withColumn("place", F.try_element_at(order, F.col("category")))
    return top(rows, 50, [F.col("place"), F.desc("score"), F.col("pair_id")]).select("pair_id", "category", "score", "rank")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs per category; categories without pairs count 0."""
    every = spark.createDataFrame([(c,) for c in clones.CATEGORIES], "category string")
    rows = clones_combined(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))
    return every.join(rows, "category", "left").fillna(0, ["pairs"])


def intentional_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of one or two lines stand for stubs, folders for classes."""
    sims = read_table(spark, sf, "clone").where("semantic_sim is not null and not isnan(semantic_sim)").dropDuplicates(["pair_id"]).select("pair_id", F.col("semantic_sim").alias("similarity"))
    rows = entity_pairs(spark, sf).where("lines_a > 0 and lines_b > 0").join(sims, "pair_id")
    folder = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    rows = rows.withColumn("stub_a", F.col("lines_a") <= 2).withColumn("stub_b", F.col("lines_b") <= 2).withColumn("class_a", folder("file_a")).withColumn("class_b", folder("file_b")).withColumn("name_similarity", clones.name_similarity(F.col("name_a"), F.col("name_b")))
    return rows.select("pair_id", clones.intentional(rows).alias("intentional"))


def clone_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The longest block among each pair's listed blocks against the stored one, in lines."""
    rows = read_table(spark, sf, "clone").where("blocks is not null").dropDuplicates(["pair_id"])
    return rows.select("pair_id", F.aggregate("blocks", F.lit(0), lambda a, b: F.greatest(a, F.coalesce(b["length"], F.lit(0)))).alias("longest"), F.size("blocks").alias("blocks"))


def detector_flags(spark: SparkSession, sf: str) -> DataFrame:
    found = detectors.flag_items({"constant": magic_constants(spark, sf).select(F.col("value").alias("item"), "severity"), "sensitive": sensitive_scores(spark, sf).select(F.col("value_id").cast("string").alias("item"), "severity")})
    return found.groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("items"))


# -------------------------------------------------------------------------------------------------------- audit


def package_imports(spark: SparkSession, sf: str) -> DataFrame:
    return audit.package_imports(files(spark, sf))


def package_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return audit.package_metrics(files(spark, sf))


def kitchen_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories as packages, with limits that fit the test data."""
    rows = files(spark, sf).withColumn("package", F.col("repo"))
    return audit.kitchen_sinks(audit.package_metrics(rows), 500, 5, 6).select("package", "files", "loc", "fan_out")


def shallow_packages(spark: SparkSession, sf: str) -> DataFrame:
    return audit.shallow_packages(audit.package_metrics(files(spark, sf)), 200, 100).select("package", "loc", "ratio")


def oversized_files(spark: SparkSession, sf: str) -> DataFrame:
    return audit.oversized_files(files(spark, sf), 150, 80, 3).select("file", "loc", "top_import_statements")


def function_imports(spark: SparkSession, sf: str) -> DataFrame:
    return audit.function_imports(files(spark, sf))


def package_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Import cycles between packages, named by the second part of their path, as imported modules name them."""
    second = lambda c: F.split_part(c, F.lit("."), F.lit(2))
    rows = files(spark, sf).where("package is not null").select(second(F.col("package")).alias("src"), F.explode("imports").alias("i"))
    imports = rows.select("src", second(F.col("i.target_module")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()
    return audit.package_cycles(imports).select("cycle", "packages", F.array_join("members", ",").alias("members"))


def cycle_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Links between repositories in one cycle of clone pairs."""
    return audit.cycle_imports(repo_edges(spark, sf).select("src", "dst")).select("src", "dst", "cycle")


def import_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Imported modules with the longest known package that begins them."""
    rows = files(spark, sf)
    modules = rows.select(F.explode("imports").alias("i")).select(F.col("i.target_module").alias("module")).where("module is not null")
    packages = rows.select(F.explode("imports").alias("i")).select(F.col("i.target_package").alias("package")).where("package is not null").distinct()
    return audit.resolve_packages(modules, packages)


def enclosing_packages(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    roots = rows.where("package_root is not null").select(F.col("package_root").alias("folder"), F.col("package_root").alias("package")).distinct()
    return audit.enclosing_package(rows.where("file is not null"), roots)


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where("content is not null").select("file_id", fx.language_of(F.col("file")).alias("language"), fx.code_lines(F.col("content")).alias("lines"))


# ------------------------------------------------------------------------------------------------------ history


def churn_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return history.churn(commits(spark, sf), 2)


def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return history.change_counts(commits(spark, sf))


def file_authors(spark: SparkSession, sf: str) -> DataFrame:
    return history.authors(commits(spark, sf))


def code_evolution(spark: SparkSession, sf: str) -> DataFrame:
    return history.evolution(commits(spark, sf).withColumn("file", fx.renamed_path(F.col("file"))))


def commits_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.filtered(commits(spark, sf), "saffron", "2023-01-01", "no date")
    return rows.where(history.path_filter(F.col("file"), "*/src/*")).select("commit_hash", fx.renamed_path(F.col("file")).alias("file"))


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    """A commit's range in a file: as many lines as it added."""
    upto = F.greatest(F.lit(1), F.coalesce("added", F.lit(1)))
    return commits(spark, sf).select(fx.renamed_path(F.col("file")).alias("file"), F.col("commit_hash").alias("commit"), F.col("ts").alias("time"), F.lit(1).alias("start"), upto.alias("upto"))


def blame_context(spark: SparkSession, sf: str) -> DataFrame:
    """Commits on the lines of each entity; a commit touches as many lines of a file as it added."""
    spans = entities(spark, sf).where("lines is not null").select("node", "file", "first", (F.col("first") + F.col("lines") - 1).alias("last"))
    return history.blame_summary(_marks(spark, sf), spans)


def change_set(spark: SparkSession, sf: str) -> DataFrame:
    """Files as first and as last seen, and those in one state only."""
    rows = read_table(spark, sf, "file_analysis").where("file is not null")
    first = rows.groupBy("file").agg(F.min_by("size", "ingested_at").alias("size")).where("size % 3 <> 0 or size is null")
    last = rows.groupBy("file").agg(F.max_by("size", "ingested_at").alias("size")).where("size % 5 <> 0 or size is null")
    return history.differences(first, last, "file", ["size"])


# ------------------------------------------------------------------------------------- sources, streams and sinks


def settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sensitive_value").where("context_text is not null").dropDuplicates(["value_id"])
    return logs.key_values(rows, "value_id", "context_text")


def json_settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sensitive_value").where("file like '%.json'").dropDuplicates(["value_id"])
    return logs.json_values(rows, "value_id", "context_text")


def stack_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames printed from the entities and read again, with the local file they belong to."""
    line = F.concat(F.lit('File "'), F.col("file"), F.lit('", line '), F.col("first"), F.lit(", in "), F.col("name"))
    rows = entities(spark, sf).groupBy(F.col("name").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(line)), " | ").alias("trace"))
    frames = logs.stack_frames(rows, "id", "trace")
    return logs.local_file(frames, entities(spark, sf).select("file").distinct()).select("id", "pos", "style", "file", "line", "function", "local")


def numstat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every commit printed as a log and read again."""
    rows = commits(spark, sf)
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    body = F.concat_ws("\t", count("added"), count("removed"), F.col("file"))
    text = rows.groupBy("repo", "commit_hash").agg(F.concat_ws("\n", F.col("commit_hash"), F.array_join(F.sort_array(F.collect_list(body)), "\n")).alias("t"))
    return logs.numstat(logs.text_lines(text, "commit_hash", "t")).select("commit", "file", "added", "removed")


def _commit_line() -> Column:
    return F.concat_ws("|", "commit_hash", "author", F.concat(F.replace(F.lower("author"), F.lit(" "), F.lit(".")), F.lit("@host.invalid")), F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint").cast("string"), F.concat(F.lit("touch | "), "file"))


def one_line_log(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of a known author printed one a line and read again."""
    rows = commits(spark, sf).where("author is not null").groupBy("commit_hash", "author", "ts").agg(F.min("file").alias("file"))
    found = logs.one_line_log(logs.text_lines(rows.select("commit_hash", _commit_line().alias("t")), "commit_hash", "t"))
    return found.select("commit", "author", "email", F.unix_seconds("time").alias("at"), "subject")


def function_history(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of files printed as logs of a function with one diff line for each count, and read again."""
    rows = commits(spark, sf).where("author is not null and added is not null")
    text = F.concat(_commit_line(), F.lit("\n@@ -1 +1 @@\n+"), F.col("added").cast("string"))
    key = F.struct("file", "commit_hash", "added", "removed")
    found = logs.function_log(logs.text_lines(rows.select(key.alias("key"), text.alias("t")), "key", "t")).where("line like '+%'")
    return found.select("id.file", "commit", "author", F.expr("cast(substring(line, 2) as bigint)").alias("added"))


def author_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Commits per author printed as a summary and read again."""
    rows = commits(spark, sf).where("author is not null").groupBy("author").agg(F.countDistinct("commit_hash").cast("string").alias("n"))
    found = logs.author_counts(logs.text_lines(rows.select("author", F.concat(F.lit("  "), "n", F.lit("\t"), "author").alias("t")), "author", "t"))
    return found.select("commits", "author")


def commit_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = commits(spark, sf).select("commit_hash", F.concat_ws(" ", "commit_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+0000")).alias("t")).distinct()
    return logs.dated_commits(logs.text_lines(rows, "commit_hash", "t")).select("commit", F.date_format("day", "yyyy-MM-dd").alias("day"))


def rename_log(spark: SparkSession, sf: str) -> DataFrame:
    """Renames of the change table printed as states and read again."""
    inside = r"\{([^{}]*) => ([^{}]*)\}"
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", inside, "$1"), " => .*$", ""), "/+", "/")
    rows = commits(spark, sf).where("file like '% => %'").select("commit_hash", old.alias("old"), fx.renamed_path(F.col("file")).alias("new")).distinct()
    text = F.concat(F.col("commit_hash"), F.lit("\nR090\t"), "old", F.lit("\t"), "new")
    return logs.rename_log(logs.text_lines(rows.select("commit_hash", text.alias("t")), "commit_hash", "t")).select("commit", "old", "new", "score")


def source_facts(spark: SparkSession, sf: str) -> DataFrame:
    return tree.facts(files(spark, sf)).groupBy("language", "fact").agg(F.count(F.lit(1)).alias("facts"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "click", "deleted").otherwise("modified")
    return read_table(spark, sf, "events").select(F.concat(F.lit("src/f"), F.col("user_id"), F.lit(".py")).alias("path"), kind.alias("change"), "ts", F.lit(10).alias("size"), F.lit(None).cast("string").alias("target"))


def debounced_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user as a stream of their own; an hour of silence ends a batch."""
    out = changes.debounced(changes.watched(_events(spark, sf)).withColumn("repo", F.col("path")), 3_600_000, "repo")
    return out.select("path", "batch", "change", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def markdown_results(spark: SparkSession, sf: str) -> DataFrame:
    return formats.as_markdown(entities(spark, sf), "name", "file", "lines")


def xml_results(spark: SparkSession, sf: str) -> DataFrame:
    return formats.as_xml(read_table(spark, sf, "documents").where("title is not null"), "doc", ["doc_id", "lang"], "title")


def json_results(spark: SparkSession, sf: str) -> DataFrame:
    return formats.as_json(entities(spark, sf).select("node", "name"), ["node", "name"])


def folder_tree(spark: SparkSession, sf: str) -> DataFrame:
    return formats.folder_counts(files(spark, sf).where("file is not null"), "file")


def redacted_settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sensitive_value").where("original_value is not null and context_text is not null").dropDuplicates(["value_id"])
    return rows.select("value_id", formats.redacted_line(F.col("context_text"), F.col("original_value")).alias("line"))


def flagged_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a mark above the lines of their entities, and the marks taken out again."""
    rows = files(spark, sf).where("content is not null and file is not null").select("file", F.replace("content", F.lit("\r"), F.lit("")).alias("content"))
    flags = entities(spark, sf).select("file", F.col("first").alias("line"), F.concat(F.lit("seen "), F.col("name")).alias("note"))
    marked = formats.flagged(rows, flags)
    back = formats.unflagged(marked).toDF("file", "restored")
    return marked.join(back, "file").join(rows.toDF("file", "before"), "file").select("file", (F.length("content") > F.length("before")).alias("marked"), (F.col("restored") == F.col("before")).alias("restored"))


QUERIES = {
    f.__name__: f
    for f in (
        dead_code, tramp_pairs, tramp_groups, magic_constants, sensitive_scores, sensitive_distribution, string_features, echo_comments, clone_candidates, clones_syntactic, clones_semantic, clones_combined, clone_actions, intentional_pairs,
        clone_blocks, detector_flags, package_imports, package_metrics, kitchen_sinks, shallow_packages, oversized_files, function_imports, package_cycles, import_targets, enclosing_packages, code_lines, churn_hotspots, change_counts,
        file_authors, code_evolution, commits_filtered, blame_context, change_set, settings, json_settings, stack_frames, numstat_log, source_facts, debounced_changes, markdown_results, xml_results, json_results, folder_tree,
        redacted_settings, flagged_files, action_counts, clones_ordered, category_counts, cycle_imports, one_line_log, function_history, author_counts, commit_days, rename_log,
    )
}

_TEST = r"regexp_matches(lower(name), '^(test|spec)|(test|spec)$') or regexp_matches(lower(regexp_replace(regexp_extract(file, '[^/]*$'), '\.[^.]*$', '')), '^(test_|spec_)|(_test|_spec)$')"
_ONE = "select * from (select *, row_number() over (partition by {0} order by ingested_at) as n1 from {1}) where n1 = 1"
_VALUES = f"vals as ({_ONE.format('value_id', 'sensitive_value')})"
_CLONE = f"c as ({_ONE.format('pair_id', 'clone')})"
_CATEGORY = "case when s >= 0.9999 and y >= 0.95 then 'EXACT' when s >= 0.98 and y >= 0.80 then 'NEAR' when s >= 0.95 and y >= 0.50 then 'SEMANTIC-STRUCTURAL' when y >= 0.70 and b >= 5 then 'STRUCTURAL' when s >= 0.95 then 'SEMANTIC' else 'PARTIAL' end"
_LINES = r"lines as (select id, row_number() over (partition by id order by pos) - 1 as pos, line, tokens from (select id, pos, trim(line, ' ') as line, list_distinct(list_filter(string_split_regex(trim(line, ' '), '[^a-zA-Z0-9_]+'), lambda t: t <> '')) as tokens from (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)) where length(line) >= 5 and len(tokens) >= 2)"
_CAND = ", marks as (select distinct id, line from lines), rare as (select line from marks group by line having count(*) between 2 and 20), m as (select marks.* from marks join rare using (line)), cand as (select x.id as a, y.id as b, count(*) as shared from m x join m y on x.line = y.line and x.id < y.id group by 1, 2 having count(*) >= 2)"
_IMPORTS = "imp as (select src, dst, count(*) as imports from (select package as src, unnest(list_concat(list_transform(imports, lambda x: x.target_package), list_transform(in_function_imports, lambda x: x.target_package))) as dst from files where package is not null) where dst is not null and src <> dst group by 1, 2)"
_METRICS = """base as (select package, count(*) as files, cast(sum(coalesce(loc, 0)) as bigint) as loc from files where package is not null group by 1), fo as (select src as package, count(*) as fan_out from imp group by 1),
fac as (select i.target_package as package, count(distinct i.target_module) as interface from (select unnest(imports) as i from files where package is not null) where i.target_package is not null group by 1),
met as (select package, files, loc, coalesce(fan_out, 0) as fan_out, greatest(1, coalesce(interface, 0)) as interface, round(loc / greatest(1, coalesce(interface, 0)), 2) as ratio from base left join fo using (package) left join fac using (package))"""
_SENS = f"with {_VALUES} select value_id, case when length(original_value) > 40 then left(original_value, 37) || '...' else original_value end as value_preview, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as severity from vals where confidence >= 0.35"
_MAGIC = "select value, count(*) as uses, count(distinct file) as files, case when count(*) >= 10 then 'high' when count(*) >= 5 then 'medium' else 'low' end as severity from (select source as file, unnest(regexp_extract_all(text, '(\\d+)', 1)) as value from documents where text is not null) where value not in ('0', '1', '') group by value having count(*) >= 3 and count(distinct file) >= 2"
_BLAMED = f"{COMMITS}, marks as (select file, commit_hash as commit, ts as time, greatest(1, coalesce(added, 1)) as upto from commits)"

_SCORE = "case when s <= 0 and y <= 0 then 0 else least(1.0, case when s > 0 and y > 0 then 1.0 / (0.65::double / s + 0.35::double / y) else 0.65::double * s + 0.35::double * y end + case when b >= 5 then 0.03::double else 0 end) end"
_ACTIONS = f"with {PAIRS}, {_CLONE}, v as (select pair_id, coalesce(semantic_sim, 0) as s, coalesce(syntactic_pct, 0) as y, coalesce(max_block_size, 0) as b from c where not coalesce(isnan(semantic_sim), false)), k as (select pair_id, s, y, {_SCORE} as score from v), a as (select pair_id, case when name_a = name_b and file_a <> file_b then 'EXTRACT: Move ' || chr(39) || name_a || chr(39) || ' to shared utility module' when file_a = file_b then 'MERGE: Combine into single parameterized function' when score >= 0.95 then 'CONSOLIDATE: High semantic and structural overlap' when s >= 0.95 and y < 0.5 then 'REVIEW: Similar behavior, different implementation' when y >= 0.7 then 'CONSOLIDATE: High line-by-line overlap' else 'REVIEW: Consider if these should be unified' end as action from k join pairs using (pair_id))"
_COMBINED = f"with {_CLONE}, v as (select pair_id, semantic_sim as s, coalesce(syntactic_pct, 0) as y, coalesce(max_block_size, 0) as b from c where semantic_sim is not null and not isnan(semantic_sim)), comb as (select pair_id, round({_SCORE}, 6) as score, {_CATEGORY} as category from v)"
_CATEGORIES = "(values ('EXACT', 0), ('NEAR', 1), ('SEMANTIC-STRUCTURAL', 2), ('STRUCTURAL', 3), ('SEMANTIC', 4), ('PARTIAL', 5)) as t(category, place)"
_RAW = COMMITS.replace("select commit_hash, ", "select file as raw, commit_hash, ", 1)

SQL = {
    "dead_code": f"with {ENTITIES}, cand as (select node, name, kind, lines, {_TEST} as test, case when file like '%.go' then regexp_matches(name[1], '[a-z]') when regexp_matches(file, '\\.(js|jsx|mjs|cjs)$') then regexp_matches(name, '^[_#]') when file like '%.py' then starts_with(name, '_') and not starts_with(name, '__') else starts_with(name, '_') end as private, first % 7 = 0 as decorated from entities where kind is not null and lines is not null), conf as (select node, name, round(greatest(0, least(1, 0.85::double - case when decorated then 0.80::double else 0 end - case when node in (select a from pairs where a <> b) then 0.50::double else 0 end - case when kind = 'function' then 0.15::double else 0 end)), 4) as confidence from cand where kind <> 'class' and not regexp_matches(name, '^__.*__$') and name not in ('init', 'constructor') and not test and lines >= 3 and not private and node not in (select b from pairs where a <> b and b is not null) and name not in (select variable_name from sensitive_value where variable_name is not null)) select *, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as severity from conf where confidence >= 0.1",
    "settings": rf"with {_VALUES}, l as (select value_id as id, unnest(string_split_regex(context_text, '\r?\n')) as line, generate_subscripts(string_split_regex(context_text, '\r?\n'), 1) as line_no from vals where context_text is not null), k as (select id, line_no, trim(line[1:instr(line, case when contains(line, '=') then '=' else ':' end) - 1], ' ') as key, trim(line[instr(line, case when contains(line, '=') then '=' else ':' end) + 1:], ' ') as v from l where not regexp_matches(ltrim(line, ' '), '^[#;!]') and regexp_matches(line, '[=:]')), u as (select id, cast(line_no as int) as line, key, case when regexp_matches(v, '^''.*''[,;]?$') then regexp_replace(v, '^''(.*)''[,;]?$', '\1') when regexp_matches(v, '^\".*\"[,;]?$') then regexp_replace(v, '^\"(.*)\"[,;]?$', '\1') else v end as value from k) select * from u where length(value) between 8 and 500 and key <> ''",
    "redacted_settings": f"with {_VALUES}, r as (select value_id, context_text as t, original_value as v, case when position(chr(34) || original_value || chr(34) in context_text) > 0 then chr(34) when position(chr(39) || original_value || chr(39) in context_text) > 0 then chr(39) when position('`' || original_value || '`' in context_text) > 0 then '`' else '' end as q from vals where original_value is not null and context_text is not null) select value_id, case when position(q || v || q in t) = 0 then t else substr(t, 1, position(q || v || q in t) - 1) || q || '***REDACTED***' || q || substr(t, position(q || v || q in t) + length(q || v || q)) end as line from r",
    "json_results": f"with {ENTITIES} select '{{\"node\":\"' || node || '\",\"name\":\"' || name || '\"}}' as value from entities",
    "tramp_pairs": "with b as (select distinct l_orderkey as node, p_brand as param from lineitem join part on l_partkey = p_partkey) select x.param as p, y.param as q, count(*) as functions from b x join b y on x.node = y.node and x.param < y.param group by 1, 2 having count(*) >= 100",
    "magic_constants": _MAGIC,
    "sensitive_scores": _SENS,
    "sensitive_distribution": f"select severity, count(*) as rows from ({_SENS}) group by severity",
    "echo_comments": r"""with w as (select doc_id, side, pos, unnest(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]', ' ', 'g'), ' +'), lambda t: length(t) >= 2)) as w from (select doc_id, 'c' as side, 0 as pos, title as x from documents where title is not null and text is not null union all select doc_id, 't', unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) from documents where title is not null and text is not null)),
n as (select doc_id, side, pos, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 as slot, count(*) as c from w group by all), norms as (select doc_id, side, pos, sqrt(sum(c * c)) as norm from n group by all),
s as (select a.doc_id, b.pos, sum(a.c * b.c) / any_value(na.norm * nb.norm) as sim from n a join n b on a.doc_id = b.doc_id and a.slot = b.slot and a.side = 'c' and b.side = 't' join norms na on na.doc_id = a.doc_id and na.side = 'c' join norms nb on nb.doc_id = a.doc_id and nb.side = 't' and nb.pos = b.pos group by a.doc_id, b.pos),
m as (select doc_id, max(sim) as sim from s group by doc_id)
select doc_id, round(sim, 6) as similarity, case when sim >= 0.95 then 'critical' when sim >= 0.90 then 'high' when sim >= 0.85 then 'medium' else 'low' end as severity from m where sim >= 0.5""",
    "clone_candidates": f"with {_LINES}{_CAND} select * from cand",
    "clones_semantic": "with u as (select embedding::double[] as v, min(vec_id) as id, count(*) as copies from embeddings where embedding is not null group by 1) select a.id as a, b.id as b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) as similarity, a.copies as copies_a, b.copies as copies_b from u a join u b on a.id < b.id where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.35",
    "clones_combined": f"{_COMBINED} select * from comb",
    "clone_blocks": f"with {_CLONE} select pair_id, cast(coalesce(list_max(list_transform(blocks, lambda b: coalesce(b.length, 0))), 0) as int) as longest, cast(len(blocks) as int) as blocks from c where blocks is not null",
    "clone_actions": f"{_ACTIONS} select * from a",
    "intentional_pairs": f"with {PAIRS}, {_CLONE}, v as (select pairs.*, semantic_sim as s, regexp_extract(file_a, '^(.*)/', 1) as ca, regexp_extract(file_b, '^(.*)/', 1) as cb, 1 - levenshtein(name_a, name_b) / greatest(1, length(name_a), length(name_b))::double as ns, least(lines_a, lines_b) / greatest(lines_a, lines_b)::double as ratio from pairs join c using (pair_id) where semantic_sim is not null and not isnan(semantic_sim) and lines_a > 0 and lines_b > 0) select pair_id, case when lines_a <= 2 and lines_b <= 2 then true when lines_a <= 5 and lines_b <= 5 and s >= 0.95 then true when ca = cb and s >= 0.95 then true when s <= 0.97 then false when ns >= 0.99 and file_a <> file_b and ((lines_a <= 10 and lines_b <= 10) or ratio > 0.7) then true when file_a = file_b and ns >= 0.8 then false when file_a = file_b and ratio > 0.7 then true else ns < 0.85 end as intentional from v",
    "detector_flags": f"select 'constant' as detector, severity, count(*) as items from ({_MAGIC}) group by severity union all select 'sensitive', severity, count(*) from ({_SENS}) group by severity",
    "package_imports": f"with {FILES}, {_IMPORTS} select * from imp",
    "package_metrics": f"with {FILES}, {_IMPORTS}, {_METRICS} select * from met",
    "kitchen_sinks": f"with {FILES.replace('select * from (select *', 'select * replace (repo as package) from (select *')}, {_IMPORTS}, {_METRICS} select package, files, loc, fan_out from met where (loc > 500 or files > 5) and fan_out > 6",
    "shallow_packages": f"with {FILES}, {_IMPORTS}, {_METRICS} select package, loc, ratio from met where ratio < 200 and loc >= 100",
    "oversized_files": f"with {FILES} select file, loc, top_import_statements from files where loc > 150 or (loc > 80 and top_import_statements > 3)",
    "function_imports": f"with {FILES}, t as (select package, coalesce(i.target_package, '?') as target, count(*) as c from (select package, unnest(in_function_imports) as i from files where package is not null) group by 1, 2), r as (select *, row_number() over (partition by package order by c desc, target) as n from t) select package, cast(sum(c) as bigint) as total, cast(sum(case when n <= 3 then c else 0 end) as bigint) as top_imports, cast(sum(case when n > 3 then c else 0 end) as bigint) as elsewhere from r group by package",
    "package_cycles": f"with recursive {FILES}, imp as (select distinct src, dst from (select src, split_part(i.target_module, '.', 2) as dst from (select split_part(package, '.', 2) as src, unnest(imports) as i from files where package is not null)) where src <> '' and dst <> '' and src <> dst), reach(src, dst) as (select src, dst from imp union select r.src, e.dst from reach r join imp e on r.dst = e.src), cyc as (select a.src as node, min(a.dst) as cycle from reach a join reach b on a.src = b.dst and a.dst = b.src group by 1) select cycle, count(*) as packages, string_agg(node, ',' order by node) as members from cyc group by cycle having count(*) > 1",
    "import_targets": f"with {FILES}, i as (select unnest(imports) as i from files), m as (select distinct i.target_module as module from i where i.target_module is not null), p as (select distinct i.target_package as package from i where i.target_package is not null) select module, max_by(package, length(package)) as package from m join p on module = package or starts_with(module, package || '.') group by module",
    "enclosing_packages": f"with {FILES}, r as (select distinct package_root as folder from files where package_root is not null) select file, max_by(folder, length(folder)) as package from (select distinct file from files where file is not null) f join r on starts_with(file, folder || '/') group by file",
    "code_lines": f"with {FILES} select file_id, case regexp_extract(file, '\\.([^./]+)$', 1) when 'py' then 'python' when 'go' then 'go' when 'java' then 'java' when 'c' then 'c' when 'sh' then 'bash' else 'javascript' end as language, cast(len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> '' and not regexp_matches(ltrim(x, ' '), '^(#|//|--|\\*|/\\*)'))) as int) as lines from files where content is not null",
    "churn_hotspots": f"with {COMMITS} select file, count(distinct commit_hash) as commits, cast(sum(coalesce(added, 0)) as bigint) as added, cast(sum(coalesce(removed, 0)) as bigint) as removed, min(ts) as first_change, max(ts) as last_change, cast(sum(coalesce(added, 0)) + sum(coalesce(removed, 0)) as bigint) as churn from commits group by file having count(distinct commit_hash) >= 2",
    "change_counts": f"with {COMMITS} select file, count(*) as changes from commits where added is not null and removed is not null group by file",
    "file_authors": f"with {COMMITS}, t as (select file, author, count(*) as changes from commits where author is not null group by 1, 2), r as (select *, count(*) over (partition by file) as authors, cast(row_number() over (partition by file order by changes desc, author) as int) as rank from t) select * from r where rank <= 5",
    "code_evolution": f"with {COMMITS}, t as (select file, author, count(distinct commit_hash) as c, sum(coalesce(added, 0)) as a, sum(coalesce(removed, 0)) as r from commits group by 1, 2) select file, cast(sum(c) as bigint) as commits, count(author) as authors, cast(sum(a) as bigint) as added, cast(sum(r) as bigint) as removed, first(author order by case when author is null then 1 else 0 end, c desc, author) as most_active, cast((sum(a) + sum(r)) // sum(c) as bigint) as mean_change from t group by file",
    "commits_filtered": f"with {COMMITS.replace('select commit_hash, ', 'select file as raw, commit_hash, ', 1)} select commit_hash, file from commits where contains(lower(author), 'saffron') and ts >= timestamp '2023-01-01' and raw like '%/src/%'",
    "blame_context": f"with {ENTITIES}, {_BLAMED} select node, count(distinct commit) as commits, max_by(commit, (time, commit)) as newest, min_by(commit, (time, commit)) as oldest from entities join marks using (file) where first <= upto and first + lines - 1 >= 1 group by node",
    "simple_map": f"with {ENTITIES}, {_BLAMED}, h as (select node, count(distinct commit) as commits from entities join marks using (file) where first <= upto and first + lines - 1 >= 1 group by node) select node, round(coalesce(commits, 0) + lines / 1e6, 6) as score from entities left join h using (node) where lines is not null",
    "change_set": "with a as (select file, min_by(size, ingested_at) as size from file_analysis where file is not null group by file having min_by(size, ingested_at) % 3 <> 0 or min_by(size, ingested_at) is null), b as (select file, max_by(size, ingested_at) as size from file_analysis where file is not null group by file having max_by(size, ingested_at) % 5 <> 0 or max_by(size, ingested_at) is null) select coalesce(a.file, b.file) as file, case when a.file is null then 'added' when b.file is null then 'deleted' when a.size is distinct from b.size then 'modified' else 'unchanged' end as change from a full join b on a.file = b.file",
    "numstat_log": f"with {COMMITS.replace('select commit_hash, ', 'select file as raw, commit_hash, ', 1)} select commit_hash as commit, raw as file, added, removed from commits",
    "debounced_changes": "with e as (select 'src/f' || user_id || '.py' as path, case event_type when 'view' then 'created' when 'click' then 'deleted' else 'modified' end as change, ts from events), g as (select *, case when coalesce(epoch_ms(ts) - epoch_ms(lag(ts) over (partition by path order by ts, path)) >= 3600000, true) then 1 else 0 end as s from e), b as (select *, sum(s) over (partition by path order by ts, path rows unbounded preceding) as batch from g), x as (select path, batch, min_by(change, (ts, change)) as first, max_by(change, (ts, change)) as change, max(ts) as ts from b group by 1, 2) select path, cast(batch as bigint) as batch, change, epoch_us(ts) as at from x where not (first = 'created' and change = 'deleted')",
    "markdown_results": f"with {ENTITIES} select '- **' || name || '** `' || file || '` ' || coalesce(lines::varchar, '') as value from entities",
    "xml_results": "select '<doc doc_id=\"' || doc_id || '\" lang=\"' || coalesce(lang, '') || '\">' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</doc>' as value from documents where title is not null",
    "folder_tree": f"with {FILES}, p as (select file, string_split(file, '/') as s from files where file is not null), f as (select file, unnest(list_transform(generate_series(1, len(s) - 1), lambda i: array_to_string(s[1:i], '/'))) as folder from p) select folder, cast(len(string_split(folder, '/')) as int) as depth, count(distinct file) as files from f group by folder",
    "flagged_files": f"with {FILES}, {ENTITIES.replace('pairs as', 'pairs as', 1)} select distinct f.file, exists (select 1 from entities e where e.file = f.file and e.first <= len(string_split(f.content, chr(10)))) as marked, true as restored from files f where content is not null and f.file in (select file from entities)",
    "action_counts": f"{_ACTIONS} select split_part(action, ':', 1) as kind, count(*) as pairs from a group by 1",
    "clones_ordered": f"{_COMBINED} select pair_id, category, score, cast(row_number() over (order by place, score desc, pair_id) as int) as rank from comb join {_CATEGORIES} using (category) order by rank limit 50",
    "category_counts": f"{_COMBINED} select t.category, count(pair_id) as pairs from {_CATEGORIES} left join comb using (category) group by t.category",
    "simple_map_lines": f"with {ENTITIES} select node, cast(lines as double) as score from entities where lines is not null",
    "simple_map_rollup": f"with {ENTITIES}, {_BLAMED}, h as (select node, count(distinct commit) as commits from entities join marks using (file) where first <= upto and first + lines - 1 >= 1 group by node), sc as (select node, file, coalesce(commits, 0) + lines / 1e6 as score from entities left join h using (node) where lines is not null), ad as (select file as node, 0.3::double * sqrt(sum(score)) as score from sc group by file) select node, round(score, 6) as score from sc union all select node, round(score, 6) from ad",
    "cycle_imports": f"with recursive {repo_edges_sql()}, reach(src, dst) as (select src, dst from edges union select r.src, e.dst from reach r join edges e on r.dst = e.src), cyc as (select a.src as node, min(a.dst) as cycle from reach a join reach b on a.src = b.dst and a.dst = b.src group by 1) select src, dst, x.cycle from edges join cyc x on x.node = src join cyc y on y.node = dst where x.cycle = y.cycle",
    "one_line_log": f"with {_RAW} select commit_hash as commit, author, replace(lower(author), ' ', '.') || '@host.invalid' as email, cast(epoch(ts) as bigint) as at, 'touch | ' || min(raw) as subject from commits where author is not null group by commit_hash, author, ts",
    "function_history": f"with {_RAW} select raw as file, commit_hash as commit, author, added from commits where author is not null and added is not null",
    "author_counts": f"with {COMMITS} select count(distinct commit_hash) as commits, author from commits where author is not null group by author",
    "commit_days": f"with {COMMITS} select distinct commit_hash as commit, strftime(ts, '%Y-%m-%d') as day from (select distinct commit_hash, ts from commits)",
    "rename_log": f"with {_RAW} select distinct commit_hash as commit, regexp_replace(regexp_replace(regexp_replace(raw, '\\{{([^{{}}]*) => ([^{{}}]*)\\}}', '\\1', 'g'), ' => .*$', ''), '/+', '/', 'g') as old, file as new, 90 as score from commits where contains(raw, ' => ')",
    "string_features": rf"""with {_VALUES}, x as (select value_id, original_value as v, string_split(original_value, '') as c, length(original_value) as n from vals where original_value is not null),
k as (select *, list_transform(c, lambda y: case when regexp_matches(y, '^[a-z]$') then 1 when regexp_matches(y, '^[A-Z]$') then 2 when regexp_matches(y, '^[0-9]$') then 3 else 4 end) as kinds, list_filter(range(1, n + 1), lambda i: i = 1 or c[i] <> c[i - 1]) as starts from x)
select value_id, n as length, round(case when n > 0 then coalesce(0 - list_sum(list_transform(map_values(list_histogram(c)), lambda y: y / n * log2(y / n))), 0) else 0 end, 6) as entropy,
{', '.join(f"round(case when n > 0 then (n - length(regexp_replace(v, '{p}', '', 'g'))) / n else 0 end, 6) as {f}" for f, p in (('lower', '[a-z]'), ('upper', '[A-Z]'), ('digits', '[0-9]'), ('symbols', '[^A-Za-z0-9' + chr(92) + 's]'), ('blanks', chr(92) + 's')))},
case when n > 0 then len(list_distinct(c)) else 0 end as distinct, case when n > 0 then len(list_filter(range(2, n + 1), lambda i: kinds[i] <> kinds[i - 1])) else 0 end as changes,
case when n > 0 then list_max(list_transform(range(1, len(starts) + 1), lambda i: coalesce(starts[i + 1], n + 1) - starts[i])) else 0 end as longest_run,
{', '.join(f"cast(regexp_matches(v, '{p}') as bigint) as {f}" for f, p in (('identifier', r'^[A-Za-z_]\w*$'), ('hex', '^(0x)?[0-9a-fA-F]{16,}$'), ('base64', '^[A-Za-z0-9+/]{16,}={0,2}$'), ('uuid', '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$'), ('email', r'^[\w.+-]+@[\w-]+(\.[\w-]+)+$'), ('url', r'^[a-zA-Z][\w+.-]*://'), ('url_login', r'://[^/\s:@]+:[^/\s@]+@'), ('path', r'^(\.{0,2}/|[A-Za-z]:\\)'), ('key_prefix', r'^(AKIA|ghp_|gho_|ghs_|sk-|sk_live_|xox[abp]-|glpat-|SG\.|AIza|-----BEGIN)'), ('jwt', r'^eyJ[\w-]+\.eyJ'), ('placeholder', r'(?i)(change.?me|your|example|placeholder|x{4,}|\*{3,}|<.*>|\$\{)')))},
len(list_filter(string_split_regex(v, '\s+'), lambda w: w <> '')) as words from k""",
    "clones_syntactic": f"with {_LINES}{_CAND}, pr as (select a, b, x.pos as pos_a, y.pos as pos_b, len(list_intersect(x.tokens, y.tokens)) as c, len(x.tokens) as na, len(y.tokens) as nb from cand join lines x on x.id = a join lines y on y.id = b), sc as (select *, c / (na + nb - c)::double as sim from pr where c > 0), best as (select * from (select *, row_number() over (partition by a, b, pos_a order by sim desc, pos_b) as n from sc) where n = 1 and sim >= 0.7), fl as (select *, case when coalesce(lag(pos_a) over w + 1 = pos_a and lag(pos_b) over w + 1 = pos_b and sim >= 0.95, false) then 0 else 1 end as begins from best window w as (partition by a, b order by pos_a)), rn as (select *, sum(begins) over (partition by a, b order by pos_a) as run from fl), bl as (select a, b, run, count(*) as length from rn group by 1, 2, 3), g as (select a, b, cast(sum(length) as bigint) as matched, max(case when length >= 2 then length else 0 end) as max_block from bl group by 1, 2), t as (select id as a, count(*) as total from lines group by id) select a, b, round(matched / total, 6) as share, matched, total, max_block, case when matched / total >= 0.95 then 'EXACT' when matched / total >= 0.80 and max_block >= 5 then 'NEAR' when max_block >= 5 then 'STRUCTURAL' else 'PARTIAL' end as category from g join t using (a) where matched >= greatest(1, floor(total * 0.5))",
    "json_settings": f"with {_VALUES} select value_id as id, replace(j.fullkey, '$.', '') as path, json_extract_string(context_text, j.fullkey) as value from vals, json_tree(context_text) j where file like '%.json' and json_valid(context_text) and j.type = 'VARCHAR'",
    "stack_frames": f"with {ENTITIES}, t as (select distinct name, file, first, 'File " + '"' + "' || file || '" + '"' + ", line ' || first || ', in ' || name as x from entities) select name as id, cast(row_number() over (partition by name order by x) - 1 as int) as pos, 'python' as style, file, cast(first as int) as line, name as function, file as local from t",
}
