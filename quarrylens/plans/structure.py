"""Queries on packages read from the source files themselves, and the audit built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import audit
from quarrylens.plans.bindings import FILES, files
from quarrylens.session import cut
from quarrylens.sources import packages

_LANGUAGES = {"python": "py", "go": "go", "java": "java", "javascript": "js|jsx|mjs|cjs"}


def source_imports(spark: SparkSession, sf: str) -> DataFrame:
    return packages.file_imports(files(spark, sf))


def source_packages(spark: SparkSession, sf: str) -> DataFrame:
    return packages.file_packages(files(spark, sf))


def source_facades(spark: SparkSession, sf: str) -> DataFrame:
    return packages.facades(files(spark, sf)).select("package", F.array_join("public_symbols", ",").alias("symbols"), "public_params")


def header_facades(spark: SparkSession, sf: str) -> DataFrame:
    """Public symbols of the packages that name themselves in a clause."""
    rows = files(spark, sf).where("file like '%.java'")
    return packages.facades(rows).select("package", F.explode("public_symbols").alias("symbol"))


def dominant_language(spark: SparkSession, sf: str) -> DataFrame:
    return packages.dominant_language(files(spark, sf))


def layout_warning(spark: SparkSession, sf: str) -> DataFrame:
    return packages.layout_warning(files(spark, sf).where("file like '%.java'"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(files(spark, sf).where("file is not null").select("file", "content", "loc", "top_import_statements", "imports", "in_function_imports"))
    held = cut(packages.file_packages(rows).where("package is not null"))
    known = rows.join(held.select("file", "package"), "file")
    metrics = audit.package_metrics(known, packages.facades(rows))
    return audit.findings(rows, packages.resolved_imports(rows), metrics, 10, {"loc": 150, "files": 1, "fan_out": 0, "least": 80, "lines": 150, "some": 80, "imports": 3})


def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    return audit.report(_findings(spark, sf))


QUERIES = {f.__name__: f for f in (source_imports, source_packages, source_facades, header_facades, dominant_language, layout_warning, audit_findings, audit_report)}

_LANG = "case " + " ".join(f"when regexp_matches(file, '\\.({x})$') then '{k}'" for k, x in _LANGUAGES.items()) + " end"
_SRC = f"src as (select file, content, {_LANG} as language from files where file is not null and content is not null)"
_quote = lambda p: p.replace("'", "''")
_IMPORTED = " union all ".join(
    f"select file, language, unnest(regexp_extract_all(content, '{_quote(p)}', 1)) as target, {str(packages.DIALECTS[k].functions_import).lower()} and regexp_matches(unnest(regexp_extract_all(content, '{_quote(p)}', 0)), '^[ \\t]') as inside from src where language = '{k}'"
    for k in _LANGUAGES
    for p in packages.DIALECTS[k].imports
)
_JAVA = packages.DIALECTS["java"]

SQL = {
    "source_imports": f"with {FILES}, {_SRC}, x as ({_IMPORTED}) select * from x where target <> ''",
    "dominant_language": f"with {FILES}, l as (select case when regexp_matches(file, '\\.c$') then 'c' when regexp_matches(file, '\\.sh$') then 'bash' else {_LANG} end as language from files where content is not null) select language, count(*) as files from l where language not in ('c', 'bash') group by language order by 2 desc, 1 limit 1",
    "header_facades": f"with {FILES}, p as (select nullif(regexp_extract(content, '{_JAVA.header}', 1), '') as package, regexp_extract_all(content, '{_quote(_JAVA.public)}', 1) as s from files where content is not null and file like '%.java') select distinct package, unnest(s) as symbol from p where package is not null",
    "layout_warning": f"with {FILES}, p as (select nullif(regexp_extract(content, '{_JAVA.header}', 1), '') as package from files where content is not null and file like '%.java') select count(*) as detected, count(package) as walked, count(package) < 0.5 * count(*) as warning from p",
}
