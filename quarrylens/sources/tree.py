"""Source trees: scan with pruning, and extraction of entities, references, literals, parameters, comments and imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import LANGUAGES, glob_regex, ignore_regex, language_of
from quarrylens.operators.history import differences

#: Folders and files a scan leaves out, and the largest file it reads.
SKIPPED_FOLDERS = [
    "venv", "env", ".venv", ".env", "node_modules", "bower_components", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", "target", "out", "bin", "obj", "vendor",
    "third_party", "external", "deps", ".idea", ".vscode", ".vs", "coverage", ".coverage", "htmlcov", ".tox", ".nox",
]
SKIPPED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock"]
LARGEST = 1_000_000


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """``(file, language, size, modified, content)`` below ``root``.

    Folders, hidden names, ignore patterns, extensions and sizes are checked on the listing; contents are read only for
    what remains, and not at all with ``content=False``.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted(LANGUAGES)) + "}").load(root)
    prefix = root.rstrip("/") + "/"
    rows = rows.withColumn("file", F.substr("path", F.locate(prefix, F.col("path")) + len(prefix)))
    parts = F.split("file", "/")
    kept = (F.col("length") <= LARGEST) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS + SKIPPED_FILES))) & ~F.exists(parts, lambda p: p.startswith("."))
    if exclude:
        kept &= ~F.arrays_overlap(parts, F.array(*map(F.lit, exclude)))
    # the last pattern that fits decides; one with "!" takes a file in again, unless its folder stays out
    ignored = F.lit(False)
    for line in ignore or []:
        line = line.strip()
        if line and not line.startswith("#"):
            ignored = F.when(F.col("file").rlike(ignore_regex(line.lstrip("!"))), F.lit(not line.startswith("!"))).otherwise(ignored)
    kept &= ~ignored
    rows = rows.where(kept)
    columns = [F.col("file"), language_of(F.col("file")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if content:
        columns.append(F.expr("decode(content, 'UTF-8')").alias("content"))
    return rows.select(*columns)


#: Fixed value: the largest text file that is read for its settings.
LARGEST_TEXT = 1 << 20


def text_files(spark: SparkSession, root: str, patterns: list[str], content: bool = True) -> DataFrame:
    """``(file, size, modified, content)`` of files whose name fits one of the shell patterns, whatever ignore files say."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    rows = rows.withColumn("file", F.substr("path", F.locate(prefix, F.col("path")) + len(prefix)))
    parts = F.split("file", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named = F.lit(False)
    for pattern in patterns:
        named |= F.element_at(parts, -1).rlike(glob_regex(pattern))
    kept = (F.col("length") <= LARGEST_TEXT) & named & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~F.exists(folders, lambda p: p.startswith("."))
    columns = [F.col("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return rows.where(kept).select(*columns, *([F.expr("decode(content, 'UTF-8')").alias("content")] if content else []))


def stale(spark: SparkSession, root: str, known: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """``(file, change)``: how a tree differs from its manifest ``known(file, size, modified)``, without reading contents."""
    return differences(known, scan(spark, root, ignore, content=False), "file", ["size", "modified"]).where("change <> 'unchanged'")


DECISIONS = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.AsyncFor, ast.Assert, ast.match_case)
UNTRACKED = {"self", "cls", "args", "kwargs", "this", "ctx", "context"}


def python_facts(file: str, text: str) -> list[dict[str, Any]]:
    """Everything the detectors ask of one Python file, as rows with a ``fact`` kind."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    out: list[dict[str, Any]] = []

    def add(fact: str, line: int, **more: Any) -> None:
        out.append({"fact": fact, "line": line, **more})

    def called(node: ast.expr, parent: str | None) -> tuple[str | None, str | None]:
        if isinstance(node, ast.Name):
            return node.id, None
        if isinstance(node, ast.Attribute):
            value = node.value
            name = value.id if isinstance(value, ast.Name) else value.attr if isinstance(value, ast.Attribute) else None
            return node.attr, parent if name in ("self", "cls") else None if isinstance(value, ast.Call) else name
        return None, None

    def walk(node: ast.AST, parent: str | None, function: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside, within = parent, function
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                body = child.body[1:] if ast.get_docstring(child) is not None else child.body
                stub = not isinstance(child, ast.ClassDef) and all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) or isinstance(x, ast.Raise) for x in body)
                add(
                    "entity", child.lineno, name=child.name, kind="class" if isinstance(child, ast.ClassDef) else "function", last=child.end_lineno, parent=parent, text="\n".join(lines[first - 1 : child.end_lineno]),
                    doc=(ast.get_docstring(child) or "")[:500] or None, complexity=1 + sum(isinstance(x, DECISIONS) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(child)), stub=stub, decorated=bool(child.decorator_list),
                )
                if isinstance(child, ast.ClassDef):
                    inside = child.name
                else:
                    within = child.name
                    for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]:
                        if a.arg not in UNTRACKED:
                            add("param", child.lineno, name=a.arg, parent=child.name)
                        if a.annotation is not None:
                            for x in ast.walk(a.annotation):
                                if isinstance(x, ast.Name):
                                    add("reference", a.lineno, name=x.id, kind="type")
            elif isinstance(child, ast.Call):
                target, receiver = called(child.func, parent)
                if target:
                    add("reference", child.lineno, name=target, kind="call", parent=receiver)
                for a in child.args:
                    if isinstance(a, ast.Name):
                        add("reference", a.lineno, name=a.id, kind="usage")
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                for a in child.names:
                    add("reference", child.lineno, name=a.name.split(".")[-1], kind="import")
                    add("import", child.lineno, name=a.name if isinstance(child, ast.Import) else base, kind="inside" if function else "top", parent=function)
            elif isinstance(child, ast.Constant) and not (isinstance(node, ast.Expr) and isinstance(child.value, str)):
                if isinstance(child.value, (int, float, str)) and not isinstance(child.value, bool):
                    name = node.targets[0].id if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) else node.arg if isinstance(node, ast.keyword) else None
                    add("literal", child.lineno, name=name, kind="string" if isinstance(child.value, str) else "number", text=str(child.value), parent=function)
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                add("used", child.lineno, name=child.id)
            walk(child, inside, within)

    walk(tree, None, None)
    code = [i for i, x in enumerate(lines) if x.strip() and not x.strip().startswith("#")]
    for i, x in enumerate(lines):
        m = re.match(r"\s*#+\s?(.*\S)", x)
        if m:
            following = next((lines[j].strip() for j in code if j > i), None)
            add("comment", i + 1, text=m[1], name=following)
    return out


#: Declared approximate: definitions, calls and imports of other languages by pattern.
DEFINITIONS = {
    "javascript": r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(class|function)\s*\*?\s+([A-Za-z_$][\w$]*)|(const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*=>)",
    "java": r"(?m)^[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:(class|interface|enum|record)\s+([A-Za-z_]\w*)|(?:<[^>\n]+>\s*)?([A-Za-z_][\w<>\[\], ?]*)\s+([a-z_]\w*)\s*\([^;\n]*\)\s*(?:throws [\w, ]+)?\{)",
    "go": r"(?m)^(?:(type)\s+([A-Za-z_]\w*)\s+(?:struct|interface)|(func)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)\s*\()",
    "c": r"(?m)^(?:(struct|union|enum)\s+([A-Za-z_]\w*)\s*\{|((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*\([^;\n]*\)\s*\{)",
    "bash": r"(?m)^[ \t]*(?:(nothing)\s+(\w+)|(function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{)",
    "typescript": r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(class|interface|enum|type|function)\s+([A-Za-z_$][\w$]*)|(const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*=>)",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?(?:(struct|enum|trait)\s+([A-Za-z_]\w*)|(?:async\s+)?(fn)\s+([A-Za-z_]\w*))",
    "kotlin": r"(?m)^[ \t]*(?:\w+\s+)*(?:(class|interface|object)\s+([A-Za-z_]\w*)|(fun)\s+(?:<[^>]+>\s*)?([A-Za-z_]\w*)\s*\()",
    "php": r"(?m)^[ \t]*(?:(?:abstract|final|public|private|protected|static)\s+)*(?:(class|interface|trait)\s+([A-Za-z_]\w*)|(function)\s+&?([A-Za-z_]\w*)\s*\()",
    "c_sharp": r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|async|override|virtual|partial)\s+)*(?:(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)|([A-Za-z_][\w<>\[\], ?]*)\s+([A-Z]\w*)\s*\([^;\n]*\)\s*\{?\s*$)",
    "scala": r"(?m)^[ \t]*(?:\w+\s+)*(?:(class|object|trait)\s+([A-Za-z_]\w*)|(def)\s+([A-Za-z_]\w*))",
}
IMPORTS = {
    "javascript": r"""(?m)(?:^\s*(?:import|export)\b[^'"\n]*['"]|\brequire\(\s*['"])([^'"\n]+)['"]""", "typescript": r"""(?m)(?:^\s*(?:import|export)\b[^'"\n]*['"]|\brequire\(\s*['"])([^'"\n]+)['"]""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "kotlin": r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)", "scala": r"(?m)^\s*import\s+([\w.]+)", "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$',
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "php": r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)", "c_sharp": r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "c": r'(?m)^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', "bash": r"(?m)^\s*(?:source|\.)\s+(\S+)",
}


def pattern_facts(language: str, text: str) -> list[dict[str, Any]]:
    """Definitions, calls, string literals, comments and imports of a language without its own parser here."""
    out: list[dict[str, Any]] = []
    spots = []
    if language in DEFINITIONS:
        for m in re.finditer(DEFINITIONS[language], text):
            kind = "class" if m[1] and m[1] not in ("function",) else "function"
            name = m[2] or m[4]
            if name and name not in ("if", "for", "while", "switch", "catch", "return", "else", "new"):
                spots.append((text.count("\n", 0, m.start(m.lastindex or 0)) + 1, kind, name))
    total = text.count("\n") + 1
    lines = text.split("\n")
    for i, (line, kind, name) in enumerate(spots):
        last = next((n for n, _, _ in spots[i + 1 :]), total + 1) - 1 if kind == "function" else total
        body = "\n".join(lines[line - 1 : last])
        complexity = 1 + len(re.findall(r"\b(?:if|for|while|case|catch|elif|when|match)\b|&&|\|\||\?[^.?:]", body))
        out.append({"fact": "entity", "line": line, "name": name, "kind": kind, "last": last, "text": body, "complexity": complexity, "stub": False, "decorated": False})
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if bare.startswith(("//", "#", "*", "/*")):
            out.append({"fact": "comment", "line": number, "text": re.sub(r"^(//+|#+|/?\*+)\s*", "", bare), "name": lines[number].strip() if number < len(lines) else None})
            continue
        for m in re.finditer(r"(?:\b([A-Za-z_$][\w$]*)\.)?\b([A-Za-z_$][\w$]*)\s*\(", line):
            if m[2] not in ("if", "for", "while", "switch", "catch", "return", "function", "func"):
                out.append({"fact": "reference", "line": number, "name": m[2], "kind": "call", "parent": m[1]})
        for m in re.finditer(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", line):
            out.append({"fact": "literal", "line": number, "kind": "string", "text": m[1] if m[1] is not None else m[2]})
        for m in re.finditer(r"(?<![\w.\"'])\d+(?:\.\d+)?(?![\w\"'])", line):
            out.append({"fact": "literal", "line": number, "kind": "number", "text": m[0]})
    for m in re.finditer(IMPORTS.get(language, r"(?!)"), text):
        out.append({"fact": "import", "line": text.count("\n", 0, m.start(1)) + 1, "name": m[1], "kind": "top"})
    return out


FACTS = "file string, language string, fact string, line int, last int, name string, kind string, parent string, text string, doc string, complexity int, stub boolean, decorated boolean"


def facts(files: DataFrame, file_col: str = "file", text_col: str = "content") -> DataFrame:
    """All facts of ``files(file, content)`` in one pass: Python by its syntax tree, other languages by patterns.

    A file that cannot be parsed, or whose text is null, gives none.
    """
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, language, text in zip(batch["file"], batch["language"], batch["text"]):
                found = python_facts(file, text) if language == "python" else pattern_facts(language, text)
                rows += [{"file": file, "language": language, **x} for x in found]
            yield pd.DataFrame({c: pd.Series([x.get(c) for x in rows], dtype="object") for c in names})

    rows = files.select(F.col(file_col).alias("file"), language_of(F.col(file_col)).alias("language"), F.col(text_col).alias("text")).where("language is not null and text is not null")
    return rows.mapInPandas(run, FACTS)
