"""Generated, minified or vendored source files.

A multi-pattern automaton (Aho-Corasick) finds notice phrases in the comments that head a file, and in those that stand
at the left margin further down, where tools put them above what they write. A phrase counts only where it is the notice
itself and not talk about notices. Path rules add vendored directories, output directories,
lockfiles and suffixes. Two shapes of the whole text need no notice: minified code and bulk data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import cut, spread

#: Phrases that begin a notice (after comment marks and decoration), in lower case, and what they tell.
#: ``^`` phrases must begin the comment's text, others may stand anywhere in it.
NOTICES = {
    "^code generated": "generated", "^@generated": "generated", "^<auto-generated": "generated", "^<autogenerated": "generated", "^auto-generated": "generated", "^autogenerated": "generated",
    "^auto generated": "generated", "^automatically generated": "generated", "^generated by": "generated", "^generated from": "generated", "^generated with": "generated", "^generated file": "generated",
    "^generated using": "generated", "^generated code": "generated", "^generated on": "generated", "^generated automatically": "generated", "^generated -": "generated", "^generated source": "generated",
    "^machine-made": "generated", "^machine-generated": "generated", "^machine generated": "generated", "^produced by": "generated", "^this file was generated": "generated", "^this file is generated": "generated",
    "^this file was automatically": "generated", "^this file is automatically": "generated", "^this file was auto": "generated", "^this file is auto": "generated", "^this file has been": "generated",
    "^this code was": "generated", "^this code is": "generated", "^this is a generated": "generated", "^this is an auto": "generated", "^file generated": "generated", "^do not edit": "generated",
    "^do not modify": "generated", "^don't edit": "generated", "^do not change": "generated", "^warning: generated": "generated", "^created by": "generated", "^emitted by": "generated", "^output of": "generated",
    "^written by a tool": "generated", "^compiled from": "generated", "^built from": "generated", "^derived automatically": "generated",
    "^automatisch erzeugt": "generated", "^automatisch generiert": "generated", "^diese datei wurde": "generated", "^generiert von": "generated", "^generiert aus": "generated", "^erzeugt von": "generated", "^nicht bearbeiten": "generated", "^nicht ändern": "generated",
    "^généré": "generated", "^fichier généré": "generated", "^ce fichier": "generated", "^ne pas modifier": "generated", "^ne pas éditer": "generated",
    "^generado": "generated", "^archivo generado": "generated", "^este archivo": "generated", "^no editar": "generated", "^no modificar": "generated",
    "do not edit by hand": "generated", "do not modify by hand": "generated", "changes will be lost": "generated", "will be overwritten": "generated", "do not edit.": "generated", "nicht bearbeiten": "generated", "ne pas modifier": "generated", "no editar": "generated",
    "^bundled copy of": "vendored", "^vendored": "vendored", "^vendored from": "vendored", "^copied from": "vendored", "^copied unchanged": "vendored", "^imported from": "vendored", "^imported unchanged": "vendored", "^imported verbatim": "vendored", "^third-party": "vendored", "^third party": "vendored",
    "^verbatim copy": "vendored", "^unmodified copy": "vendored", "^local copy of": "vendored", "^fork of": "vendored", "^forked from": "vendored", "^upstream:": "vendored", "^taken from": "vendored", "^mirrored from": "vendored", "^snapshot of": "vendored", "^this module is part of": "vendored", "^this file is part of": "vendored",
    "in the upstream distribution": "vendored", "permission to copy and change": "vendored", "permission is hereby granted": "vendored", "redistribution and use in source": "vendored", "authors. released under": "vendored", "contributors. released under": "vendored",
}
#: Directories that hold third-party copies, that may also name a business domain, and that hold output.
VENDORED = {"_vendor", "vendored", "node_modules", "bower_components", "third_party", "thirdparty", "third-party", "3rdparty", "external", "externals", "extern", "deps", "bundled", "libs", "godeps", "site-packages", "_vendored", "jspm_packages", "submodules"}
AMBIGUOUS = {"vendor", "contrib", "vendors"}
OUTPUT = {"generated", "__generated__", "gen", "autogen", "dist", "_generated", "generated-sources", "codegen-out", "out-gen"}
OUTPUT_PAIRS = {("build", "proto"), ("build", "generated"), ("build", "gen"), ("target", "generated-sources")}
#: Names that tools give to what they write.
MADE = re.compile(
    r"(\.generated\.\w+|[._]gen\.(?:go|py|c|h|js|ts)|_generated\.\w+|\.pb\.(?:go|h|cc|c)|_pb2(?:_grpc)?\.pyi?|Grpc\.java|\.tab\.[ch]|\.yy\.[ch]|_string\.go|\.g\.\w+|\.designer\.\w+|-completion\.sh|\.pb\.gw\.go|\.lock|-lock\.\w+|\.lock\.\w+"
    r"|[.-]min\.(?:js|mjs|cjs|css|jsx)|\.bundle\.(?:js|mjs|cjs|jsx)|\.prod\.(?:js|mjs|cjs|jsx)|\.chunk\.js|\.umd\.js|\.packed?\.js)$"
)
LOCKFILES = {"package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum"}
COMMENT = {
    "py": re.compile(r"[ \t]*#!?(.*)"), "sh": re.compile(r"[ \t]*#!?(.*)"),
    "": re.compile(r"[ \t]*(?://+|/\*+!?|\*+(?!/)|#!)(.*)"),
}
MARKS = " \t*!/#=-~<>[]{}|:;.\"'`•+\\"
TALK = re.compile(r"\b(reads?|writes?|skips?|marks?|marked|looks? for|checks?|strips?|replaces?|compares?|detects?|parses?|like|never|unless|whether|says?|ignores?|adds?|puts?|finds?)\b")
BANNER = re.compile(r"(?:/\*!|//!|/\*\*?|//|#)\s*(?:@license\s+|@preserve\s+)?([a-z][\w.-]*[\w])\s+v?(\d+\.\d+(?:\.\d+)?)\b")
LIBRARY = re.compile(r"(?:[Bb]undled copy of|[Vv]endored from|module is part of|[Cc]opied from|[Ii]mported from|[Ff]orked from) ([A-Za-z][\w-]*)|\(c\) the ([\w-]+) authors")

AUTOMATON = ahocorasick.Automaton()
for _phrase, _kind in NOTICES.items():
    AUTOMATON.add_word(_phrase.lstrip("^"), (_phrase, _kind))
AUTOMATON.make_automaton()


def header(text: str, name: str) -> list[str]:
    """The comments that head a file: up to its first line of code that isn't a package clause, in full."""
    pattern = COMMENT["py" if name.endswith((".py", ".pyi", ".sh", ".bash", ".toml", ".yaml", ".yml")) else ""]
    out: list[str] = []
    quoted = block = False
    for line in text.replace("\r", "\n").split("\n"):
        bare = line.strip()
        m = pattern.match(line)
        if block:
            out.append(bare.removesuffix("*/"))
            block = "*/" not in bare
        elif m:
            out.append(m[1].removesuffix("*/"))
            block = bare.startswith("/*") and "*/" not in bare
        elif quoted or bare.startswith(('"""', "'''")):
            closes = bare.count('"""') + bare.count("'''")
            out.append(bare.strip("\"'"))
            quoted = quoted != (closes % 2 == 1)
        elif bare and not bare.startswith(("package ", "'use strict'", '"use strict"')):
            break
    return out


MARGIN = {"hash": re.compile(r"#+(?!!)(.*)"), "": re.compile(r"(?://+|/\*+!?|\*+(?!/))(.*)")}
HEREDOC = re.compile(r"<<-?\s*[\\\"']?(\w+)")


def margin_comments(text: str, name: str) -> list[str]:
    """Comment lines that begin at the left margin, outside quoted blocks (heredocs, triple quotes, template literals)."""
    hashes = name.endswith((".py", ".pyi", ".sh", ".bash"))
    script, python = name.endswith((".sh", ".bash")), name.endswith((".py", ".pyi"))
    pattern, out, quoted, until = MARGIN["hash" if hashes else ""], [], "", ""
    for line in text.replace("\r", "\n").split("\n"):
        if until:
            until = "" if line.strip() == until else until
            continue
        m = None if quoted else pattern.match(line)
        if m:
            out.append(m[1].removesuffix("*/"))
        elif script:
            opened = HEREDOC.search(line)
            until = opened[1] if opened else ""
        elif python:
            for mark in ('"""', "'''"):
                if quoted in ("", mark) and line.count(mark) % 2:
                    quoted = "" if quoted else mark
                    break
        elif not hashes and name.endswith((".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".go")) and line.count("`") % 2:
            quoted = "" if quoted else "`"
    return out


def notice(lines: list[str]) -> str | None:
    """"generated" or "vendored" if one of the header's lines is such a notice."""
    for line in lines:
        low = line.lower().lstrip(MARKS.replace("<", "").replace("@", ""))
        begins = low.lstrip("<")
        for end, (phrase, kind) in AUTOMATON.iter(low):
            word = phrase.lstrip("^")
            at = end - len(word) + 1
            if phrase[0] == "^":
                if at != 0 and not (low[:at] == "<" and begins.startswith(word)):
                    continue
                if end + 1 < len(low) and low[end + 1].isalnum() and word[-1].isalnum() and word not in ("généré", "generado", "^vendored", "<auto-generated", "<autogenerated", "this file is auto", "this file was auto", "auto-generated", "autogenerated"):
                    continue
                rest = low[end + 1 :]
                if word in ("this file has been", "this code was", "this code is", "diese datei wurde", "ce fichier", "este archivo", "this is an auto", "created by") and not re.search(r"generat|produc|erzeugt|generiert|génér|gener|automat|tool|codegen|compiler", rest):
                    continue
                if word == "generated by" and re.match(r"\s*(the )?(caller|user|hand)\b", rest):
                    continue
                if word in ("this file is part of", "this module is part of") and not re.search(r"[a-z]", rest):
                    continue
                return kind
            before = low[:at]
            if (at and low[at - 1] in "'\"`") or TALK.search(before):
                continue
            return kind
    return None


def shape(text: str, name: str) -> str | None:
    """"minified" or "data" if the whole text looks like it."""
    body = text.strip()
    if len(body) < 200:
        return None
    lines = [x for x in body.split("\n") if x.strip()]
    script = name.endswith((".js", ".mjs", ".cjs", ".jsx", ".ts", ".css"))
    if script:
        code = [x for x in lines if not x.lstrip().startswith(("//", "/*", "*"))]
        size = sum(map(len, code))
        blank = sum(x.count(" ") + x.count("\t") for x in code)
        if code and size / len(code) > 180 and blank / size < 0.05 and size > 300 and sum(x.count(";") + x.count(",") + x.count("{") for x in code) / size > 0.02:
            return "minified"
    plain = re.sub(r"(?m)/\*[\s\S]*?\*/|^[ \t]*(?://|#(?!define|include))[^\n]*$", "", body)
    blobs = sum(len(m) for m in re.findall(r"[A-Za-z0-9+/=_\\-]{120,}", plain) if re.search(r"\d", m) and re.search(r"[A-Z]", m) and re.search(r"[a-z]", m) or re.fullmatch(r"[0-9a-fA-F\\x]+", m))
    solid = len(re.sub(r"\s", "", plain))
    if solid and blobs / solid > 0.85:
        return "data"
    literal = r"[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    literals = re.findall(literal, plain)
    if len(literals) >= 40:
        rest = re.sub(literal, " ", plain)
        words = re.findall(r"[A-Za-z_$][\w$]*", rest)
        numbers = sum(1 for x in literals if x[0] not in "\"'")
        if len(words) <= max(12, 0.02 * len(literals)) and (numbers > 0.8 * len(literals) or len(words) <= 8) and not re.search(r"[;{}]\s*\n.*[;{}]\s*\n.*[;{}]\s*\n", rest):
            return "data"
    return None


def path_origin(path: str, libraries: set[str] | None = None) -> str | None:
    """What the path alone tells; a directory that may name a business domain asks for a known library below it."""
    parts = path.replace("\\", "/").split("/")
    folders, name = parts[1:-1], parts[-1]
    low = [x.lower() for x in folders]
    if name.lower() in LOCKFILES:
        return "generated"
    m = MADE.search(name)
    if m:
        return "minified" if re.search(r"min|bundle|prod|chunk|umd|pack", m[1]) else "generated"
    for i, part in enumerate(low):
        below = low[i + 1] if i + 1 < len(low) else ""
        if part in VENDORED:
            return "vendored"
        if part in AMBIGUOUS and below and (below in VENDORED or below in (libraries or ()) or re.search(r"[@.]|-v?\d", below) or below in ("github.com", "golang.org", "gopkg.in")):
            return "vendored"
        if part in OUTPUT or (part, below) in OUTPUT_PAIRS:
            return "generated"
    return None


def origin_of(path: str, text: str | None) -> tuple[str | None, str | None, list[str]]:
    """(origin, reason, libraries named in its notices) of one file, without the corpus' library names."""
    name = path.rsplit("/", 1)[-1]
    by_path = path_origin(path)
    if text is None:
        return by_path, by_path and "path", []
    head = header(text, name)
    libraries = [a or b for line in head for a, b in LIBRARY.findall(line)]
    first = text.lstrip("﻿ \t\r\n").split("\n", 1)[0]
    banner = BANNER.match(first)
    if banner:
        libraries.append(banner[1])
    found = notice(head) or notice(margin_comments(text, name))
    if found:
        return found, "notice", libraries
    if by_path:
        return by_path, "path", libraries
    shaped = shape(text, name)
    if shaped:
        return shaped, "shape", libraries
    if banner and first.startswith(("/*!", "//!")):
        return "vendored", "banner", libraries
    return None, None, libraries


def file_origins(files: DataFrame, id_col: str = "file_id", file_col: str = "file", text_col: str = "content") -> DataFrame:
    """``(id, origin, reason)`` per distinct row; ``origin`` is generated, minified, vendored, data or null for hand-written.

    ``vendor/<name>`` counts as a third-party copy only if some notice in the corpus names that library: business code
    about vendors stays hand-written. Null paths are left out; with a null or empty text the path alone decides.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(file_col).alias("path"), F.col(text_col).alias("text")).where("path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            found = [origin_of(p, t) for p, t in zip(paths, batch.column(2).to_pylist())]
            under = []
            for p in paths:
                parts = [x.lower() for x in p.replace("\\", "/").split("/")[1:-1]]
                under.append(next((parts[i + 1] for i, x in enumerate(parts[:-1]) if x in AMBIGUOUS), None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array(under, pa.string())],
                ["id", "origin", "reason", "libraries", "under"],
            )

    kind = files.schema[id_col].dataType.simpleString()
    seen = spread(rows).mapInArrow(run, f"id {kind}, origin string, reason string, libraries array<string>, under string")
    seen = cut(seen)
    known = seen.select(F.explode("libraries").alias("library")).select(F.lower("library").alias("under")).distinct().withColumn("known", F.lit(True))
    # only files below such a folder meet the names; the others stay out of the join
    asks = F.col("origin").isNull() & F.col("under").isNotNull()
    copies = seen.where(asks).join(known, "under", "left").select("id", F.when(F.col("known"), "vendored").alias("origin"), F.when(F.col("known"), "path").alias("reason"))
    return copies.unionByName(seen.where(~asks).select("id", "origin", "reason")).distinct()


def not_handwritten(files: DataFrame, id_col: str = "file_id", file_col: str = "file", text_col: str = "content") -> DataFrame:
    """Ids of the files that were not written by hand for their repository, each once."""
    found = file_origins(files, id_col, file_col, text_col).where("origin is not null")
    return found.select(F.col("id").alias(id_col)).distinct()
