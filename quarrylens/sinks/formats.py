"""Results as text, and edits of source files as a table of new contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import html_escaped, language_of

MARK = "[FLAG]"


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def as_markdown(rows: DataFrame, title: str, place: str, detail: str | None = None) -> DataFrame:
    parts: list[Column] = [F.lit("- **"), F.col(title), F.lit("** `"), F.col(place), F.lit("`")]
    if detail:
        parts += [F.lit(" "), F.coalesce(F.col(detail).cast("string"), F.lit(""))]
    return rows.select(F.concat(*parts).alias("value"))


def as_xml(rows: DataFrame, tag: str, attributes: list[str], body: str | None = None) -> DataFrame:
    parts: list[Column] = [F.lit(f"<{tag}")]
    for a in attributes:
        parts += [F.lit(f' {a}="'), html_escaped(F.coalesce(F.col(a).cast("string"), F.lit(""))), F.lit('"')]
    parts += [F.lit(">"), html_escaped(F.coalesce(F.col(body).cast("string"), F.lit(""))), F.lit(f"</{tag}>")] if body else [F.lit("/>")]
    return rows.select(F.concat(*parts).alias("value"))


def folder_counts(rows: DataFrame, file_col: str) -> DataFrame:
    """``(folder, depth, files)``: how many different files lie below each folder, for a directory tree."""
    named = rows.select(F.col(file_col).alias("file"), F.split(F.col(file_col), "/").alias("parts")).where(F.size("parts") > 1)
    folders = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    out = named.select("file", F.explode(folders).alias("folder")).groupBy("folder").agg(F.countDistinct("file").alias("files"))
    return out.select("folder", F.size(F.split("folder", "/")).alias("depth"), "files")


#: What begins a line comment, by language; all others take ``//``.
LINE_COMMENT = {"python": "#", "bash": "#"}


def line_mark(file: Column) -> Column:
    """What begins a line comment in the language of a path."""
    table = F.create_map(*[F.lit(x) for pair in LINE_COMMENT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(language_of(file), F.lit(""))), F.lit("//"))


def flagged(files: DataFrame, flags: DataFrame, mark: str | None = None, replace: bool = False) -> DataFrame:
    """``(file, content)`` with a comment line above each flagged line; ``flags(file, line, note)``. Writing it is up to the caller.

    The comment is one of the file's language unless a ``mark`` is given. ``replace`` takes older flags out first (line
    numbers then count without them). Lines of a file are edited inside one expression; files without flags don't come out.
    """
    notes = flags.groupBy("file", "line").agg(F.array_join(F.sort_array(F.collect_set("note")), "; ").alias("note"))
    notes = notes.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("line", "note"))).alias("notes"))
    joined = (unflagged(files) if replace else files).join(notes, "file")
    lines = F.split("content", "\n")
    sign = F.lit(mark) if mark else line_mark(F.col("file"))
    note = lambda i: F.try_element_at("notes", (i + 1).cast("int"))
    edited = F.transform(lines, lambda x, i: F.when(note(i).isNotNull(), F.concat(F.regexp_extract(x, r"^([ \t]*)", 1), sign, F.lit(f" {MARK} "), note(i), F.lit("\n"), x)).otherwise(x))
    return joined.select("file", F.array_join(edited, "\n").alias("content"))


def unflagged(files: DataFrame) -> DataFrame:
    """``(file, content)`` without the comment lines that ``flagged`` adds."""
    kept = F.filter(F.split("content", "\n"), lambda x: ~x.rlike(r"^\s*(#|//) \[FLAG\]"))
    return files.select("file", F.array_join(kept, "\n").alias("content"))


def flag_report(files: DataFrame, flags: DataFrame) -> DataFrame:
    """What ``flagged`` would do, without doing it: ``(file, flags, lines_before, lines_after)``."""
    marked = flagged(files, flags).select("file", F.size(F.split("content", "\n")).alias("lines_after"))
    before = files.select("file", F.size(F.split("content", "\n")).alias("lines_before"))
    counts = flags.groupBy("file").agg(F.countDistinct("line").alias("flags"))
    return before.join(counts, "file").join(marked, "file").select("file", "flags", "lines_before", "lines_after")


def write_files(contents: DataFrame, root: str, backup: DataFrame | None = None) -> None:
    """Contents ``(file, content)`` below ``root``, the old ones first with ``.bak`` if ``backup`` holds them; for local or mounted folders.

    Every task writes its own files: a name beside the target, moved over it when it is whole.
    """

    def put(rows) -> None:  # noqa: ANN001
        import os

        for r in rows:
            path = os.path.join(root, r.file)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "w", encoding="utf-8", newline="") as out:
                out.write(r.content)
            os.replace(path + ".part", path)

    if backup is not None:
        backup.join(contents.select("file"), "file", "left_semi").select(F.concat("file", F.lit(".bak")).alias("file"), "content").foreachPartition(put)
    contents.select("file", "content").foreachPartition(put)


def as_tree(rows: DataFrame, file_col: str) -> DataFrame:
    """``(path, value)``: folders and files as an indented tree, one row a line, in order of ``path``."""
    files = rows.select(F.col(file_col).alias("path")).distinct()
    folders = folder_counts(rows, file_col).select(F.col("folder").alias("path"), F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at(F.split("folder", "/"), -1), F.lit("/ ("), "files", F.lit(")")).alias("value"))
    parts = F.split("path", "/")
    leaves = files.select("path", F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1)).alias("value"))
    return folders.unionByName(leaves)


def redacted_line(line: Column, value: Column, replacement: str = "***REDACTED***") -> Column:
    """The first occurrence of a value replaced: in double quotes, single quotes, backticks, or bare."""
    out = line
    for quote in ("", "`", "'", '"'):
        wanted = F.concat(F.lit(quote), value, F.lit(quote))
        at = F.position(wanted, line)
        out = F.when(at > 0, F.overlay(line, F.lit(quote + replacement + quote), at, F.length(wanted))).otherwise(out)
    return out
