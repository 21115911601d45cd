"""Line-oriented sources: version-control logs, blame, stack traces, key-value and JSON settings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, line)``."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("pos", "line"))


def carried(lines: DataFrame, value: Column, by: str = "id", order: str = "pos") -> Column:
    """The last non-null ``value`` so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def numstat(lines: DataFrame) -> DataFrame:
    """``(id, commit, file, added, removed)`` from hash lines followed by counts; ``-`` stands for a binary file.

    A hash may stand alone or behind a mark (``commit:``, ``@@``, ...), with fields behind it.
    """
    commit = F.nullif(F.regexp_extract("line", r"^(?:[^0-9a-f\s]{0,3}|commit[: ]\s*)([0-9a-f]{40})(?:$|\W)", 1), F.lit(""))
    rows = lines.withColumn("commit", carried(lines, commit)).where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+"))
    parts = F.split("line", "\t", 3)
    return rows.select("id", "commit", parts[2].alias("file"), F.expr("try_cast(split(line, '\t')[0] as bigint)").alias("added"), F.expr("try_cast(split(line, '\t')[1] as bigint)").alias("removed"))


def one_line_log(lines: DataFrame) -> DataFrame:
    """``(id, commit, author, email, time, subject)`` from ``hash|author|email|epoch|subject``; the subject may hold bars."""
    parts = F.split("line", r"\|", 5)
    return lines.where(F.size(parts) == 5).select("id", parts[0].alias("commit"), parts[1].alias("author"), parts[2].alias("email"), F.timestamp_seconds(parts[3].cast("bigint")).alias("time"), parts[4].alias("subject"))


def porcelain_blame(lines: DataFrame) -> DataFrame:
    """``(id, line, commit, author, email, time, summary)`` from either porcelain form; facts a commit gave once hold for all its lines."""
    head = F.when(F.col("line").rlike(r"^[0-9a-f]{40} \d+ \d+"), F.col("line"))
    rows = lines.withColumn("head", carried(lines, head)).where("head is not null")
    rows = rows.withColumn("commit", F.substring("head", 1, 40)).withColumn("n", F.split("head", " ")[2].cast("int"))

    def fact(prefix: str) -> Column:
        return F.max(F.when(F.col("line").startswith(prefix + " "), F.expr(f"substring(line, {len(prefix) + 2})")))

    facts = rows.groupBy("id", "commit").agg(fact("author").alias("author"), fact("author-mail").alias("email"), fact("author-time").cast("bigint").alias("epoch"), fact("summary").alias("summary"))
    marks = rows.where(F.col("line").startswith("\t")).select("id", "commit", F.col("n").alias("line"))
    return marks.join(facts, ["id", "commit"]).select("id", "line", "commit", "author", F.regexp_replace("email", "[<>]", "").alias("email"), F.timestamp_seconds("epoch").alias("time"), "summary")


def diff_hunks(lines: DataFrame) -> DataFrame:
    """``(id, pos, start, lines, line)``: each line of a diff with the range of its hunk in the new file."""
    head = F.when(F.col("line").startswith("@@"), F.col("line"))
    rows = lines.withColumn("head", carried(lines, head)).where("head is not null")
    start, count = F.regexp_extract("head", r"\+(\d+)", 1), F.regexp_extract("head", r"\+\d+,(\d+)", 1)
    return rows.select("id", "pos", start.cast("int").alias("start"), F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(head, '\\\\+\\\\d+,(\\\\d+)', 1) as int)")).alias("lines"), "line")


#: Forms of a frame by language: pattern, then which of its groups are the file, the line and the function (0: not told).
#: The first form that fits a line counts; the last one takes any ``path.ext:line``.
FRAME_FORMS = [
    ("python", r'\bFile "([^"]+)", line (\d+)(?:, in ([\w.<>]+))?', 1, 2, 3),
    ("java", r"^\s*at ([\w$.<>/]+)\(([\w$-]+\.(?:java|kt|scala|groovy|clj)):(\d+)\)", 2, 3, 1),
    ("node", r"^\s*at (?:async )?(?:new )?([\w$.<>]+)(?: \[as [\w$]+\])? \((?:file://)?([^()\s]+?):(\d+):\d+\)", 2, 3, 1),
    ("node", r"^\s*at (?:async )?(?:file://)?([^()\s]+?\.[cm]?[jt]sx?):(\d+):\d+", 1, 2, 0),
    ("rust", r"^\s*at (\S+\.rs):(\d+)(?::\d+)?", 1, 2, 0),
    ("rust", r"\bpanicked at (?:'.*', )?(\S+\.rs):(\d+):\d+", 1, 2, 0),
    ("ruby", r"^\s*(?:\d+: )?(?:from )?(\S+\.rb):(\d+):in [`'](?:block in )?([^']+)'", 1, 2, 3),
    ("go", r"^\s+(\S+\.go):(\d+)(?: \+0x[0-9a-f]+)?\s*$", 1, 2, 0),
    ("generic", r"([\w@~./\\-]+\.[A-Za-z][A-Za-z0-9]*):(\d+)\b", 1, 2, 0),
]
#: Forms of an error: pattern over the whole trace, then the groups of type and message (0: not told).
ERROR_FORMS = [
    (r"(?m)^panic: (?:runtime error: )?(.*?)(?: \[recovered\])?$", 0, 1),
    (r"panicked at '(.*)', \S+:\d+", 0, 1),
    (r"panicked at \S+:\d+:\d+:\n(.*)", 0, 1),
    (r"(?m):in [`'][^']*': (.*) \(([A-Z]\w*)\)$", 2, 1),
    (r'(?m)^(?:Exception in thread "[^"]*" |Caused by: |Uncaught )?(?:[\w$]+\.)*([A-Z][\w$]*(?:Error|Exception|Fault|Interrupt|Exit)): (.+)$', 1, 2),
    (r'(?m)^(?:Exception in thread "[^"]*" |Caused by: |Uncaught )?(?:[\w$]+\.)*([A-Z][\w$]*(?:Error|Exception|Fault|Interrupt|Exit)):?\s*$', 1, 0),
    (r"(?m)^(?:Error|error|fatal): (.+)$", 0, 1),
]


def stack_frames(traces: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, style, file, line, function)``: frames in order, each file and line once per trace; bars count as line ends."""
    rows = text_lines(traces.withColumn("__t", F.regexp_replace(text_col, r"\s*\|\s*", "\n")), id_col, "__t")
    nothing = F.lit(None).cast("string")
    frame = F.struct(nothing.alias("style"), nothing.alias("file"), nothing.alias("line"), nothing.alias("function"))
    for name, pattern, f, n, g in reversed(FRAME_FORMS):
        part = lambda i, p=pattern: F.nullif(F.regexp_extract("line", p, i), F.lit("")) if i else nothing
        frame = F.when(F.col("line").rlike(pattern), F.struct(F.lit(name).alias("style"), part(f).alias("file"), part(n).alias("line"), part(g).alias("function"))).otherwise(frame)
    found = rows.select("id", "pos", frame.alias("x")).where("x.style is not null").select("id", "pos", "x.style", "x.file", F.col("x.line").cast("int").alias("n"), "x.function")
    first = F.row_number().over(Window.partitionBy("id", "file", "n").orderBy("pos"))
    return found.withColumn("k", first).where("k = 1").select("id", "pos", "style", "file", F.col("n").alias("line"), "function")


def error_of(text: Column) -> tuple[Column, Column]:
    """(type, message) by the first form that fits; null where the form doesn't tell."""
    kind = message = F.lit(None).cast("string")
    for pattern, t, m in reversed(ERROR_FORMS):
        hit = text.rlike(pattern)
        part = lambda i, p=pattern: F.nullif(F.regexp_extract(text, p, i), F.lit("")) if i else F.lit(None).cast("string")
        kind, message = F.when(hit, part(t)).otherwise(kind), F.when(hit, part(m)).otherwise(message)
    return kind, message


def function_log(lines: DataFrame) -> DataFrame:
    """``(id, commit, author, email, time, subject, pos, line)``: each diff line of a log of one function with its commit.

    Commits head their part as ``hash|author|email|epoch|subject``; what comes before the first is dropped.
    """
    head = F.when(F.col("line").rlike(r"^[0-9a-f]{7,40}\|.*\|\d+\|"), F.col("line"))
    rows = lines.withColumn("head", carried(lines, head)).where("head is not null and line <> head")
    parts = F.split("head", r"\|", 5)
    return rows.select("id", parts[0].alias("commit"), parts[1].alias("author"), parts[2].alias("email"), F.timestamp_seconds(parts[3].cast("bigint")).alias("time"), parts[4].alias("subject"), "pos", "line")


def dated_commits(lines: DataFrame) -> DataFrame:
    """``(id, commit, day)`` from ``hash date`` lines; others are dropped."""
    parts = F.split(F.trim("line"), r"\s+", 2)
    return lines.where(F.col("line").rlike(r"^\s*[0-9a-f]{7,40}\s+\d{4}-\d\d-\d\d")).select("id", parts[0].alias("commit"), F.try_to_date(F.left(parts[1], F.lit(10)), "yyyy-MM-dd").alias("day"))


def author_counts(lines: DataFrame) -> DataFrame:
    """``(id, commits, author, email)`` from lines of a count, a name and perhaps an address in angle brackets."""
    pattern = r"^\s*(\d+)\s+(.*?)(?:\s*<([^<>]*)>)?\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.where(F.col("line").rlike(pattern)).select("id", part(1).cast("bigint").alias("commits"), part(2).alias("author"), F.nullif(part(3), F.lit("")).alias("email"))


def rename_log(lines: DataFrame) -> DataFrame:
    """``(id, commit, old, new, score)`` of the renames and copies in a log of names and states below commit lines."""
    commit = F.when(F.col("line").rlike("^[0-9a-f]{7,40}$"), F.col("line"))
    rows = lines.withColumn("commit", carried(lines, commit)).where(F.col("line").rlike(r"^[RC]\d+\t[^\t]+\t[^\t]+$"))
    parts = F.split("line", "\t", 3)
    return rows.select("id", "commit", parts[1].alias("old"), parts[2].alias("new"), F.substring(parts[0], 2, 3).cast("int").alias("score"))


def local_file(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Frames with ``local``: the file of equal path, else one whose path ends alike, else one of the same name.

    All three share the base name, so the join is an equi-join on it; the best of the few that meet is kept.
    """
    name = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    a, b = frames.withColumn("base", name(F.col("file"))), files.select(F.col("file").alias("local"), name(F.col("file")).alias("base"))
    both = a.join(b, "base", "left")
    alike = F.col("local").endswith(F.concat(F.lit("/"), F.col("file"))) | F.col("file").endswith(F.concat(F.lit("/"), F.col("local")))
    both = both.withColumn("p", F.when(F.col("local") == F.col("file"), 0).when(alike, 1).otherwise(2))
    rank = F.row_number().over(Window.partitionBy("id", "pos").orderBy("p", "local"))
    return both.withColumn("k", rank).where("k = 1").drop("k", "p", "base")


def key_values(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line, key, value)`` of settings: = before :, comment lines skipped, quotes stripped, 8 to 500 characters."""
    rows = text_lines(texts, id_col, text_col).where(~F.ltrim("line").rlike("^[#;!]") & F.col("line").rlike("[=:]"))
    by = F.when(F.col("line").contains("="), "=").otherwise(":")
    parts = F.split_part("line", by, F.lit(1)), F.expr("substr(line, instr(line, case when contains(line, '=') then '=' else ':' end) + 1)")
    value = F.regexp_replace(F.trim(parts[1]), r"^(['\"])(.*)\1[,;]?$", "$2")
    out = rows.select("id", (F.col("pos") + 1).alias("line"), F.trim(parts[0]).alias("key"), value.alias("value"))
    return out.where(F.length("value").between(8, 500) & (F.col("key") != ""))


def json_values(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, path, value)`` of every string in a JSON text; texts that aren't JSON give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[object, str, str]] = []
            for key, text in zip(batch["id"], batch["text"]):
                try:
                    todo = [("", json.loads(text))]
                except (TypeError, ValueError, RecursionError):
                    continue
                while todo:
                    path, x = todo.pop()
                    if isinstance(x, dict):
                        todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
                    elif isinstance(x, list):
                        todo += [(f"{path}[{i}]", v) for i, v in enumerate(x)]
                    elif isinstance(x, str):
                        out.append((key, path, x))
            yield pd.DataFrame(out, columns=["id", "path", "value"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, path string, value string")
