"""Packages, imports and public symbols of a source tree, for eleven languages, as column expressions on file contents.

A dialect says how a language names its packages (by folder, by a header or by a path), what imports look like, what is
public, and which manifest names the root. Patterns read one line at a time and hold no look-around, so that any engine
can run them; they are approximate where a language nests comments or strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import base_name, language_of
from quarrylens.operators.audit import enclosing_package, resolve_packages
from quarrylens.session import cut


@dataclass(frozen=True)
class Dialect:
    """``naming``: folder (below the nearest manifest), header (a clause in the file) or init (folders with ``__init__.py``)."""

    naming: str
    imports: tuple[str, ...]
    public: str
    separator: str = "."
    header: str = ""
    manifest: str = ""
    manifest_name: str = ""
    source_folder: str = ""
    functions_import: bool = False


_JS = Dialect(
    "folder", (r"""(?m)^[ \t]*(?:import|export)[ \t][^'"\n]*['"]([^'"\n]+)['"]""", r"""(?m)\brequire\([ \t]*['"]([^'"\n]+)['"]"""), r"(?m)^export[ \t]+(?:default[ \t]+)?(?:async[ \t]+)?(?:abstract[ \t]+)?(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+([A-Za-z_$][\w$]*)",
    "/", manifest="package.json", manifest_name=r'(?m)^[ \t]*"name"[ \t]*:[ \t]*"([^"]+)"', source_folder="src",
)
#: Dialects by language; JavaScript and TypeScript share one.
DIALECTS = {
    "python": Dialect("init", (r"(?m)^[ \t]*import[ \t]+([\w.]+)", r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b"), r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z]\w*)", functions_import=True),
    "go": Dialect("folder", (r'(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([\w./~-]+)"[ \t]*\r?$',), r"(?m)^(?:func|type|var|const)[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Z]\w*)", "/", manifest="go.mod", manifest_name=r"(?m)^module[ \t]+(\S+)"),
    "rust": Dialect("folder", (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)",), r"(?m)^[ \t]*pub[ \t]+(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(?:fn|struct|enum|trait|type|static|mod)[ \t]+([A-Za-z_]\w*)", "::", manifest="Cargo.toml", manifest_name=r'(?m)^name[ \t]*=[ \t]*"([^"]+)"', source_folder="src"),
    "java": Dialect("header", (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)",), r"(?m)^[ \t]*public[ \t]+(?:static[ \t]+|final[ \t]+|abstract[ \t]+)*(?:class|interface|enum|record|[\w<>\[\], ?]+)[ \t]+([A-Za-z_]\w*)[ \t]*[({<\n]", header=r"(?m)^[ \t]*package[ \t]+([\w.]+)"),
    "kotlin": Dialect("header", (r"(?m)^import[ \t]+([\w.]+)",), r"(?m)^(?:(?:public|open|abstract|data|sealed|suspend|inline|enum|const|override)[ \t]+)*(?:class|object|interface|fun|val|var)[ \t]+([A-Za-z_]\w*)", header=r"(?m)^package[ \t]+([\w.]+)"),
    "php": Dialect("header", (r"(?m)^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?\\?([\w\\]+)",), r"(?m)^[ \t]*(?:(?:abstract|final|readonly)[ \t]+)*(?:class|interface|trait|enum|function)[ \t]+([A-Za-z_]\w*)", "\\", header=r"(?m)^[ \t]*namespace[ \t]+([\w\\]+)", manifest="composer.json"),
    "c_sharp": Dialect("header", (r"(?m)^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;",), r"(?m)(?:^|[{;}])[ \t]*public[ \t]+(?:(?:static|sealed|abstract|partial|async|override|virtual|readonly)[ \t]+)*(?:class|interface|struct|enum|record|[\w<>\[\],?]+)[ \t]+([A-Za-z_]\w*)", header=r"(?m)^[ \t]*namespace[ \t]+([\w.]+)"),
    "scala": Dialect("header", (r"(?m)^[ \t]*import[ \t]+([\w.]+\w)",), r"(?m)^(?:(?:case|abstract|sealed|final|implicit|lazy)[ \t]+)*(?:class|object|trait|def|val|type)[ \t]+([A-Za-z_]\w*)", header=r"(?m)^package[ \t]+([\w.]+)", functions_import=True),
    "javascript": _JS,
    "typescript": _JS,
}


def folder_of(path: Column) -> Column:
    """The folder of a path; empty for a bare name."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?", 0), "/$", "")


def plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; what climbs out of the root stays at it."""
    start = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/"), start, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))).when(x.isin("", "."), a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(parts, "/")


def by_language(value: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = F.lit(None) if otherwise is None else otherwise
    for language, column in value.items():
        out = F.when(F.col("language") == language, column).otherwise(out)
    return out


def source_files(files: DataFrame) -> DataFrame:
    """``(file, folder, language, content)`` of ``files(file, content)`` in a language with a dialect; null contents are left out."""
    rows = files.where("file is not null and content is not null").select("file", folder_of(F.col("file")).alias("folder"), language_of(F.col("file")).alias("language"), "content")
    return rows.where(F.col("language").isin(sorted(DIALECTS)))


def roots(files: DataFrame) -> DataFrame:
    """``(folder, package, language)``: the folders of manifests and the name each gives; the folder's own name if none."""
    known = {d.manifest: (language, d.manifest_name) for language, d in DIALECTS.items() if d.manifest}
    rows = files.select("file", "content").withColumn("name", base_name(F.col("file"))).where(F.col("name").isin(sorted(known)))
    title, language = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (lang, pattern) in known.items():
        found = F.nullif(F.regexp_extract("content", pattern, 1), F.lit("")) if pattern else F.lit(None).cast("string")
        title, language = F.when(F.col("name") == name, found).otherwise(title), F.when(F.col("name") == name, F.lit("javascript" if lang == "typescript" else lang)).otherwise(language)
    folder = folder_of(F.col("file"))
    return rows.select(folder.alias("folder"), F.coalesce(title, base_name(folder)).alias("package"), language.alias("language"))


def file_packages(files: DataFrame) -> DataFrame:
    """``(file, language, package)``: every source file with the package it belongs to; null for files outside any.

    Header languages read their clause. Folder languages take the path below the nearest manifest, without a source
    folder, behind the manifest's name. Python joins the names of the folders above that hold ``__init__.py``.
    """
    rows = source_files(files)
    headers = by_language({k: F.nullif(F.regexp_extract("content", d.header, 1), F.lit("")) for k, d in DIALECTS.items() if d.naming == "header"}, F.lit(None).cast("string"))
    named = rows.where(F.col("language").isin([k for k, d in DIALECTS.items() if d.naming == "header"])).select("file", "language", headers.alias("package"))

    placed = rows.where(F.col("language").isin([k for k, d in DIALECTS.items() if d.naming == "folder"])).select("file", "folder", "language")
    family = F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language"))
    top = roots(files).select(F.col("folder").alias("root"), F.col("package").alias("module"), F.col("language").alias("family"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))
    near = placed.select("file", family.alias("family"), F.explode(above).alias("root")).join(top, ["root", "family"])
    near = near.groupBy("file").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("m"))
    placed = placed.join(near, "file", "left").select("file", "folder", "language", F.coalesce("m.root", F.lit("")).alias("root"), "m.module")
    below = F.regexp_replace(F.expr("substring(folder, length(root) + 1)"), "^/", "")
    below = by_language({k: F.regexp_replace(below, f"^{d.source_folder}(?:/|$)", "") if d.source_folder else below for k, d in DIALECTS.items() if d.naming == "folder"}, below)
    separator = by_language({k: F.lit(d.separator) for k, d in DIALECTS.items() if d.naming == "folder"}, F.lit("/"))
    module = F.when(F.col("language") == "rust", F.replace("module", F.lit("-"), F.lit("_"))).otherwise(F.col("module"))
    parts = F.filter(F.array(module, F.nullif(F.replace(below, F.lit("/"), separator), F.lit(""))), lambda x: x.isNotNull())
    by_folder = placed.select("file", "language", F.nullif(F.call_function("array_join", parts, separator), F.lit("")).alias("package"))

    python = rows.where("language = 'python'").select("file", "folder", "language")
    holders = rows.where("language = 'python' and file like '%__init__.py'").select(F.col("folder").alias("above")).distinct()
    steps = python.select("file", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))).alias("depth", "above"))
    chain = steps.join(holders.withColumn("held", F.lit(True)), "above", "left").groupBy("file").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.coalesce("held", F.lit(False)).alias("held"), base_name(F.col("above")).alias("name")))).alias("c"))
    # from the file upwards, as long as folders are packages
    last = F.aggregate("c", F.struct(F.array().cast("array<string>").alias("names"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & x["held"], F.concat(F.array(x["name"]), a["names"])).otherwise(a["names"]).alias("names"), (a["on"] & x["held"]).alias("on")))["names"]
    by_init = python.join(chain.select("file", F.nullif(F.array_join(last, "."), F.lit("")).alias("package")), "file", "left").select("file", "language", "package")
    return named.unionByName(by_folder).unionByName(by_init)


def file_imports(files: DataFrame) -> DataFrame:
    """``(file, language, target, inside)``: what every file imports; ``inside``: within a function, by its indentation."""
    rows = source_files(files)

    def found(d: Dialect) -> Column:
        both = [F.arrays_zip(F.regexp_extract_all("content", F.lit(p), 1).alias("target"), F.regexp_extract_all("content", F.lit(p), 0).alias("text")) for p in d.imports]
        return F.concat(*both) if len(both) > 1 else both[0]

    nothing = F.array().cast("array<struct<target:string,text:string>>")
    out = rows.select("file", "language", F.explode(by_language({k: found(d) for k, d in DIALECTS.items()}, nothing)).alias("x"))
    functions = F.col("language").isin([k for k, d in DIALECTS.items() if d.functions_import])
    return out.select("file", "language", F.col("x.target").alias("target"), (functions & F.col("x.text").rlike(r"^[ \t]")).alias("inside")).where("target <> ''")


def resolved_imports(files: DataFrame) -> DataFrame:
    """``(file, src, dst, inside)``: imports between packages of the tree; others are dropped.

    Relative imports go by the path (Python's dots, ``./`` in scripts, ``crate::``, ``self::`` and ``super::`` in Rust), all
    others to the longest package that begins them.
    """
    packages = cut(file_packages(files).where("package is not null"))
    rows = file_imports(files).join(packages.select("file", F.col("package").alias("src")), "file")
    level = F.length(F.regexp_extract("target", r"^\.*", 0))
    parts = F.split("src", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - level + 1)), ".")
    dotted = F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.expr("ltrim('.', target)"), F.lit("")))
    crate = F.split("src", "::")
    rusty = (
        F.when(F.col("target").startswith("crate"), F.concat(crate[0], F.expr("substring(target, 6)")))
        .when(F.col("target").startswith("self::"), F.concat("src", F.lit("::"), F.expr("substring(target, 7)")))
        .when(F.col("target").startswith("super::"), F.concat_ws("::", F.array_join(F.slice(crate, 1, F.greatest(F.lit(1), F.size(crate) - 1)), "::"), F.expr("substring(target, 8)")))
        .otherwise(F.col("target"))
    )
    name = F.when((F.col("language") == "python") & (level > 0), dotted).when(F.col("language") == "rust", rusty).otherwise(F.col("target"))
    rows = cut(rows.withColumn("module", name))

    script = F.col("language").isin("javascript", "typescript") & F.col("target").startswith(".")
    local = rows.where(script).select("file", "src", "inside", F.concat(plain_path(F.concat(folder_of(F.col("file")), F.lit("/"), F.col("target"))), F.lit("/x")).alias("at"))
    folders = packages.select(folder_of(F.col("file")).alias("folder"), "package").where("folder <> ''").groupBy("folder").agg(F.min("package").alias("package"))
    reached = enclosing_package(local.select(F.col("at").alias("file")), folders).toDF("at", "dst")
    out = local.join(reached, "at").select("file", "src", "dst", "inside")
    for separator in sorted({d.separator for d in DIALECTS.values()}):
        langs = [k for k, d in DIALECTS.items() if d.separator == separator]
        mine, known = rows.where(~script & F.col("language").isin(langs)), packages.where(F.col("language").isin(langs)).select("package").distinct()
        found = resolve_packages(mine.select("module"), known, separator).toDF("module", "dst")
        out = out.unionByName(mine.join(found, "module").select("file", "src", "dst", "inside"))
    return out.where("src <> dst")


def facades(files: DataFrame) -> DataFrame:
    """``(package, public_symbols, public_params)`` of every package: what others may use.

    Python: ``__all__`` of the package's ``__init__.py``, else its public definitions; Go leaves tests out.
    """
    rows = source_files(files).join(file_packages(files).select("file", "package"), "file").where("package is not null")
    listed = F.regexp_extract_all(F.regexp_extract("content", r"__all__[ \t]*=[ \t]*[\[(]([^\])]*)[\])]", 1), F.lit(r"""['"](\w+)['"]"""), 1)
    names = by_language({k: F.regexp_extract_all("content", F.lit(d.public), 1) for k, d in DIALECTS.items()}, F.array().cast("array<string>"))
    init = F.col("file").endswith("__init__.py")
    symbols = F.when((F.col("language") == "python") & ~init, F.array().cast("array<string>")).when((F.col("language") == "python") & (F.size(listed) > 0), listed).when(F.col("file").endswith("_test.go"), F.array().cast("array<string>")).otherwise(names)
    params = F.size(F.filter(F.split(F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^(?:pub[ \t]+|export[ \t]+|public[ \t]+)?(?:async[ \t]+)?(?:def|func|fn|fun|function)[ \t]+[A-Za-z]\w*[ \t]*\(([^)\n]*)\)"), 1), ","), ","), lambda x: F.trim(x) != ""))
    public = rows.select("package", symbols.alias("s"), F.when(F.size(symbols) > 0, params).otherwise(0).alias("p"))
    counts = public.groupBy("package").agg(F.sum("p").alias("public_params"))
    held = public.select("package", F.explode("s").alias("s")).groupBy("package").agg(F.sort_array(F.collect_set("s")).alias("public_symbols"))
    return counts.join(held, "package", "left").select("package", F.coalesce("public_symbols", F.array().cast("array<string>")).alias("public_symbols"), "public_params")


def dominant_language(files: DataFrame) -> DataFrame:
    """One row ``(language, files)``: the language with most files, of equal ones the first by name."""
    counts = source_files(files).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    return counts.orderBy(F.desc("files"), "language").limit(1)


def layout_warning(files: DataFrame) -> DataFrame:
    """One row ``(detected, walked, warning)``: source files, those of them in a package, and whether most stay outside."""
    counts = file_packages(files).agg(F.count(F.lit(1)).alias("detected"), F.count("package").alias("walked"))
    return counts.withColumn("warning", F.col("walked") < 0.5 * F.col("detected"))
