"""Column functions on names, paths, texts and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    "py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "cts": "typescript", "mts": "typescript",
    "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "hpp": "cpp", "hxx": "cpp", "c": "c", "h": "c", "php": "php", "cs": "c_sharp",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash",
}
#: Names of functions that say little about structure, compared in lower case.
UTILITIES = [
    "print", "println", "printf", "eprint", "eprintln", "log", "debug", "info", "warn", "error", "trace", "fatal", "console", "assert", "panic", "exit", "len", "str", "int", "float", "bool", "list",
    "dict", "set", "tuple", "range", "open", "close", "read", "write", "append", "extend", "get", "has", "delete", "remove", "pop", "push",
]


def words(text: Column) -> Column:
    """Search terms: camel case is split, everything else than letters and digits separates, terms have two characters or more."""
    split = F.split(F.regexp_replace(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]", " "), " +")
    return F.filter(split, lambda t: F.length(t) >= 2)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path's extension, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def node_id(file: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("::", file, name, line.cast("string"))


def qualified_name(parent: Column, name: Column) -> Column:
    return F.when(parent.isNotNull() & (parent != ""), F.concat_ws(".", parent, name)).otherwise(name)


def is_private(name: Column, language: Column) -> Column:
    """Go: a small first letter; JavaScript and TypeScript: _ or #; Python: _ but not __; otherwise _."""
    return (
        F.when(language == "go", F.substring(name, 1, 1).rlike("[a-z]"))
        .when(language.isin("javascript", "typescript"), name.rlike("^[_#]"))
        .when(language == "python", name.startswith("_") & ~name.startswith("__"))
        .otherwise(name.startswith("_"))
    )


def is_test(name: Column, file: Column) -> Column:
    """The name begins or ends with test or spec in any case, or the file is named like a test."""
    low, stem = F.lower(name), F.regexp_replace(F.lower(base_name(file)), r"\.[^.]*$", "")
    ends = low.startswith("test") | low.startswith("spec") | low.endswith("test") | low.endswith("spec")
    return ends | stem.rlike("^(test_|spec_)") | stem.rlike("(_test|_spec)$")


def line_count(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), last - first + 1)


def is_utility(name: Column) -> Column:
    return F.lower(name).isin(UTILITIES)


def spread_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " ")


def searchable_text(name: Column, kind: Column, doc: Column, source: Column, boost: int = 7) -> Column:
    """The name and its words repeated, then type, documentation and source."""
    return F.concat_ws(" ", F.repeat(F.concat(name, F.lit(" ")), boost), F.repeat(F.concat(spread_name(name), F.lit(" ")), boost), kind, doc, source)


def signature(source: Column, header_lines: Column) -> Column:
    """The lines up to the body, the first five if the body is unknown."""
    lines = F.split(source, "\n")
    return F.array_join(F.slice(lines, 1, F.greatest(F.lit(1), F.coalesce(header_lines, F.lit(5)))), "\n")


def head_lines(source: Column) -> Column:
    """How many lines a signature has: up to the first with a colon or an opening brace, one if there is none."""
    lines = F.split(source, "\n")
    marks = F.transform(lines, lambda x, i: F.when(x.contains(":") | x.contains("{"), i + 1))
    return F.coalesce(F.array_min(marks), F.lit(1)).cast("int")


def snippet(source: Column, most: int = 15) -> Column:
    """The signature and as much of the body as ``most`` lines hold, with a last line that tells how many more there are."""
    lines, head = F.split(source, "\n"), head_lines(source)
    body = F.lit(most) - head - 1
    shown = F.slice(lines, 1, head + F.greatest(body, F.lit(0)))
    mark = F.when(body <= 0, F.lit("    # ...")).otherwise(F.format_string("    # ... (%d more lines)", F.size(lines) - F.size(shown)))
    return F.when(F.size(lines) <= most, source).otherwise(F.array_join(F.concat(shown, F.array(mark)), "\n"))


def semantic_text(name: Column, source: Column, most: int = 5) -> Column:
    """What an encoder is given: the name, its words, the signature and the first lines of the body."""
    lines, head = F.split(source, "\n"), head_lines(source)
    body = F.trim(F.array_join(F.slice(lines, head + 1, F.lit(most)), "\n"))
    title = F.concat(name, F.lit(" "), F.lower(spread_name(name)), F.lit("\n"), F.array_join(F.slice(lines, F.lit(1), head), "\n"))
    return F.when(body == "", title).otherwise(F.concat(title, F.lit("\n"), body))


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor a line comment."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).isin("") & ~F.ltrim(x).rlike("^(#|//|--|\\*|/\\*)")))


def module_of(path: Column) -> Column:
    """The folder below ``src``, otherwise the first folder, "root" for a bare file."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src")
    inside = (at > 0) & (F.size(parts) > at + 1)
    return F.when(inside, F.try_element_at(parts, (at + 1).cast("int"))).when(F.size(parts) > 1, parts[0]).otherwise("root")


def renamed_path(path: Column) -> Column:
    """``dir/{old => new}/x`` and ``old => new`` as the new path."""
    inner = F.regexp_replace(path, r"\{([^{}]*) => ([^{}]*)\}", "$2")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "/+", "/")


def preview(value: Column, most: int = 40) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 3)), F.lit("..."))).otherwise(value)


def token_estimate(text: Column, per_token: float = 3.2) -> Column:
    """Characters per token: 3.2 for code, 4.0 for prose; at least one token."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / per_token).cast("int"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / size)
    return F.when(size > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def unquoted(text: Column) -> Column:
    """A literal without its quotes, single, double or triple."""
    return F.regexp_replace(text, r"""^[bBrRuUfF]{0,2}("{3}|'{3}|["'`])([\s\S]*)\1$""", "$2")


def comment_text(text: Column) -> Column:
    """A comment without its marks and in one line."""
    bare = F.regexp_replace(F.trim(text), r"^(//+|#+|--|/\*+|<!--)\s*|\s*(\*/|-->)$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\n\s*\*?\s*", " "), r"\s+", " "))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def any_date(text: Column) -> Column:
    """The first of seven usual formats that fits; null if none does."""
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def glob_regex(pattern: str) -> str:
    """A shell pattern as a whole-string regular expression: * and ? match any character, / included."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            out.append("[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def ignore_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression on relative paths (without a leading !)."""
    anchored, folder = pattern.startswith("/") or "/" in pattern.rstrip("/"), pattern.endswith("/")
    body = pattern.strip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])))
            i += 1
    return ("^" if anchored else "(?:^|.*/)") + "".join(out) + ("/.*$" if folder else "(?:/.*)?$")


def cosine(a: Column, b: Column) -> Column:
    """Dot product, the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def risk(fan_in: Column, fan_out: Column, complexity: Column) -> Column:
    return (fan_in + fan_out) * F.log1p(F.coalesce(complexity, F.lit(1)).cast("double"))


def risk_category(fan_in: Column, fan_out: Column, complexity: Column) -> Column:
    coupled, complicated = (fan_in + fan_out) >= 50, F.coalesce(complexity, F.lit(1)) >= 10
    return F.when(coupled & complicated, "Danger Zone").when(coupled, "Traffic Jam").when(complicated, "Local Mess").otherwise("Low Risk")


def tier(value: Column, *steps: tuple[float, str], rest: str = "low") -> Column:
    """The label of the first step that ``value`` reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(value >= least, label)
    return out.otherwise(rest)


#: Labels of a score's tenths of the largest score, from the top.
DECILES = ["critical", "high", "elevated", "moderate", "medium", "notable", "low", "minimal", "safe", "optimal"]


def decile(score: Column, most: Column) -> Column:
    """The label of ``score / most``; the lowest where there is no largest score."""
    ratio = F.when(most > 0, score / most).otherwise(0.0)
    return tier(ratio, *[((9 - i) / 10, label) for i, label in enumerate(DECILES[:-1])], rest=DECILES[-1])


def project_key(path: Column) -> Column:
    """The key of a project's stored artifacts."""
    return F.sha2(path, 256)


def seconds(duration: str) -> int:
    """``90s``, ``30m``, ``1h`` or plain seconds; 0 for nothing."""
    text = (duration or "").strip().lower()
    scale = {"s": 1, "m": 60, "h": 3600}.get(text[-1:], 0)
    return int(text[:-1]) * scale if scale else int(text or 0)


def thresholds(text: str) -> dict[str, float]:
    """``name=1.5,other=2`` as numbers; parts without a name or a number raise a ValueError."""
    return {k.strip(): float(v) for k, v in (part.split("=", 1) for part in text.split(",") if part.strip())}
