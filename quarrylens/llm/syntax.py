"""Source files that do not parse.

Language-specific lexers feed a pushdown automaton. The lexer finds unterminated literals and characters no token
can begin with; the stack finds unbalanced delimiters, premature ends and missing block bodies; the transition rules
between token classes find merge-conflict markers, text of another kind and operands without an operator. Nothing is
executed or compiled.
"""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.session import spread

#: File extensions and the language whose lexer reads them.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "java": "java", "go": "go", "c": "c", "h": "c", "sh": "bash", "bash": "bash",
}

CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$")


class Broken(Exception):
    """What is wrong, and on which line."""

    def __init__(self, kind: str, line: int) -> None:
        super().__init__(kind)
        self.kind, self.line = kind, line


# --------------------------------------------------------------------------------------------- brace languages

#: Reserved words by language.
JS_WORDS = set(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof "
    "new return super switch this throw try typeof var void while with yield let static async await of get set enum null true false".split()
)
JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto "
    "if implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while null true false var record sealed permits yield non-sealed".split()
)
GO_WORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select "
    "struct switch type var".split()
)
C_WORDS = set(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short "
    "signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Atomic _Alignas _Alignof _Noreturn _Static_assert "
    "_Thread_local _Generic typeof alignas alignof bool constexpr nullptr thread_local".split()
)
#: Words that are operands, that may stand right after an operand, that open a condition in parentheses.
VALUE_WORDS = {"this", "super", "null", "true", "false", "nullptr"}
INFIX_WORDS = {"in", "of", "instanceof", "extends", "implements", "throws", "permits", "as", "from", "range", "default", "else", "while", "catch", "finally"}
CONTROL_WORDS = {"if", "for", "while", "switch", "catch", "with", "synchronized", "try", "select"}
JS_AFTER, JS_BEFORE = {"from", "as", "of"}, {"async", "get", "set", "static", "of", "let", "as", "await", "yield", "accessor"}
JS_SOFT = {"async", "of", "get", "set", "static", "let", "as", "from", "await", "yield", "type", "accessor"}

OPERATORS = sorted(
    ">>>= <<= >>= >>> === !== **= &&= ||= ??= ... == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= &^= &^ << >> -> => :: := <- ** "
    "+ - * / % & | ^ ! ~ = < > ? : ; , . ( ) [ ] { } @ #".split(),
    key=len,
    reverse=True,
)
OPERATOR = "|".join(map(re.escape, OPERATORS))
NUMBER = r"0[xX][0-9a-fA-F_]+[uUlLn]*|0[bBoO][0-7_]+[uUlLn]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlLuUni]*"
IDENT = r"[^\W\d][\w$]*+|\$[\w$]*+"
JS_IDENT = r"#?[^\W\d#][\w$]*+|#?\$[\w$]*+"

LEX = {
    lang: re.compile(rf"[ \t\r\f\v﻿]*(?:(?P<id>{JS_IDENT if lang == 'javascript' else IDENT})|(?P<nl>\n[ \t]*)|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<open>/\*)|(?P<num>{NUMBER})|(?P<op>{OPERATOR})|(?P<end>$)|(?P<odd>(?s:.)))", re.S)
    for lang in ("javascript", "java", "go", "c")
}
STRING_END = {q: re.compile(rf"(?:[^{q}\\\n]++|\\.)*+{q}", re.S) for q in "\"'"}
JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
JAVA_BLOCK = re.compile(r'"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""', re.S)
CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|x[0-9a-fA-F]+|U[0-9a-fA-F]{8}|[0-7]{1,3}|.))'")
DIRECTIVE = re.compile(r"#[ \t]*([A-Za-z_]\w*)?((?:[^\n\\]|\\\r?\n|\\.)*)")
#: Directives of the C preprocessor.
DIRECTIVES = set("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma embed ident import".split())

#: Numbers with commas behind them: after a comma a run of them leaves the automaton where the first pair does.
RUN = re.compile(r"(?:(?:0[xX][0-9a-fA-F]++|[1-9]\d*+(?:\.\d++)?|0(?:\.\d++)?)[ \t]*+,[ \t\r\n]*+){3,}+")

Token = tuple[str, str, int, bool]  # class, text, line, first on its line


def brace_tokens(lang: str, text: str) -> Iterator[Token]:
    """Tokens of JavaScript, Java, Go or C. Template literals come as one string token per piece and ``${`` ... ``}`` around the code."""
    lex, pos, line, first, prev, size = LEX[lang], 0, 1, True, "", len(text)
    words = {"javascript": JS_WORDS, "java": JAVA_WORDS, "go": GO_WORDS, "c": C_WORDS}[lang]
    templates: list[int] = []  # depth of braces at each open ${
    conditions: list[int] = []
    if lang == "javascript" and text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else size

    def piece(at: int) -> tuple[int, bool]:
        """End of a template piece and whether code follows."""
        while at < size:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1, False
            elif text.startswith("${", at):
                return at + 2, True
            else:
                at += 1
        raise Broken("unterminated template", line)

    match, c_like, quotes = lex.match, lang == "c", "\"'`" if lang in ("javascript", "go") else "\"'"
    while pos < size:
        ch = text[pos]
        if first and ch in "<>=|" and (not pos or text[pos - 1] == "\n") and CONFLICT.match(text, pos, text.find("\n", pos) if text.find("\n", pos) >= 0 else size):
            raise Broken("merge-conflict marker", line)
        if ch == " " or ch == "\t":
            pos += 1
            continue
        if ch == "#" and first and c_like:
            m = DIRECTIVE.match(text, pos)
            assert m
            name = m[1] or ""
            if name not in DIRECTIVES and (name or m[2].strip()):
                raise Broken("unknown directive", line)
            if name in ("if", "ifdef", "ifndef"):
                conditions.append(line)
            elif name == "endif":
                if not conditions:
                    raise Broken("#endif without #if", line)
                conditions.pop()
            line += m[0].count("\n")
            pos = m.end()
            continue
        if ch in quotes:
            began = line
            if ch == "`":
                if lang == "go":
                    end = text.find("`", pos + 1) + 1
                    if not end:
                        raise Broken("unterminated raw string", line)
                else:
                    end, more = piece(pos + 1)
                    line += text.count("\n", pos, end)
                    yield ("str", "`", began, first)
                    if more:
                        yield ("op", "${", line, False)
                        templates.append(0)
                    pos, first, prev = end, False, "${" if more else "str"
                    continue
            elif lang == "java" and text.startswith('"""', pos):
                m = JAVA_BLOCK.match(text, pos)
                if not m:
                    raise Broken("unterminated text block", line)
                end = m.end()
            elif ch == "'" and lang in ("java", "go"):
                m = CHAR.match(text, pos)
                if not m:
                    raise Broken("malformed character literal", line)
                end = m.end()
            else:
                m = STRING_END[ch].match(text, pos + 1)
                if not m or (lang == "java" or lang == "go") and "\n" in m[0]:
                    raise Broken("unterminated string", line)
                end = m.end()
            line += text.count("\n", pos, end)
            yield ("str", ch, began, first)
            pos, first, prev = end, False, "str"
            continue
        m = match(text, pos)
        kind = m.lastgroup
        value = m[m.lastindex]
        if kind == "nl":
            line, first = line + 1, True
        elif kind == "end":
            break
        elif kind == "odd":
            if value in quotes or value == "#":
                pos = m.end() - 1
                continue
            raise Broken("character outside any token", line)
        elif kind == "com":
            line += value.count("\n")
        elif kind == "open":
            raise Broken("unterminated comment", line)
        else:
            if kind == "op" and value[0] == "/" and lang == "javascript" and prev not in ("operand", "str", ")", "]", "}"):
                r = JS_REGEX.match(text, m.start("op"))
                if not r:
                    raise Broken("unterminated regular expression", line)
                yield ("str", "/", line, first)
                pos, first, prev = r.end(), False, "str"
                continue
            if lang == "c" and kind == "op" and value == "@" or kind == "op" and value == "#":
                raise Broken("character outside any token", line)
            if kind == "id" and value in words:
                kind = "kw"
            if templates and value in ("{", "}"):
                if value == "{":
                    templates[-1] += 1
                elif templates[-1]:
                    templates[-1] -= 1
                else:
                    yield ("op", "$}", line, first)
                    templates.pop()
                    began = line
                    end, more = piece(m.end())
                    line += text.count("\n", m.end(), end)
                    if more:
                        yield ("op", "${", line, False)
                        templates.append(0)
                    pos, first, prev = end, False, "${" if more else "str"
                    continue
            if kind == "num" and prev == ",":
                run = RUN.match(text, m.start("num"))
                if run:
                    yield ("num", value, line, first)
                    line += text.count("\n", pos, run.end())
                    yield ("op", ",", line, False)
                    pos = run.end()
                    first = "\n" in text[text.rindex(",", 0, pos) : pos]
                    continue
            yield (kind, value, line, first)
            prev = "operand" if kind in ("id", "num") or kind == "kw" and value in VALUE_WORDS else value
            first = False
        pos = m.end()
    if conditions:
        raise Broken("unterminated #if", conditions[-1])


PAIRS = {")": "(", "]": "[", "}": "{", "$}": "${"}
PREFIX = {"+", "-", "!", "~", "*", "&", "++", "--", "...", "<-", "@", "**"}
CLOSE_AFTER_OPERATOR = {
    "javascript": {"++", "--"},
    "java": {"++", "--", ">", ">>", ">>>", "?", "...", "::"},
    "go": {"++", "--", "...", "*", "&", "<-", ":"},
    "c": {"++", "--", "*", "...", "**"},
}
STOPS = {")", "]", "}", ";", ",", "$}"}
STARTS = {"", ";", "{", "}"}
OPENED, STARTS_OR_CLOSED = STARTS | {"(", "[", ",", "${"}, STARTS | {")"}
ENDED = {lang: STARTS | STOPS | {"(", "[", "{", "${", ":"} | more for lang, more in CLOSE_AFTER_OPERATOR.items()}
OPERANDS = {"id", "num", "str"}
NOT_BINARY = {*PAIRS, "(", "[", "{", "${", ";", ",", "@", "#"} | PREFIX
CALLED_WORDS = VALUE_WORDS | {"get", "set", "of", "static", "async", "import"}
#: What a declaration at the outermost level can begin with.
TOP = {
    "java": {"package", "import", "class", "interface", "enum", "record", "public", "private", "protected", "abstract", "final", "static", "sealed", "non", "strictfp", "@", ";", "module", "open"},
    "go": {"package", "import", "func", "var", "const", "type", ";"},
}


def brace_check(lang: str, text: str) -> None:
    """Raise ``Broken`` where the token sequence cannot belong to the language."""
    js, java, go, c = lang == "javascript", lang == "java", lang == "go", lang == "c"
    top, ended = TOP.get(lang), ENDED[lang]
    stack: list[tuple[str, int, str]] = []  # opener, line, what it belongs to
    pk, pv, pline = "op", "", 1  # previous token's class, text, line
    head = ""  # what the parenthesis just closed belonged to
    run = 0  # identifiers side by side
    shouted = False  # all of them in capitals, as macros are
    starts = True  # a new declaration at the outermost level begins
    classy = False  # a class, interface, enum or struct header is being read
    packaged = not go
    tries: list[int] = []  # depth of each try whose handler is still to come
    awaiting, prior, resources = "", "", -1  # the token before the previous one; where a try with resources began
    for kind, value, line, first in brace_tokens(lang, text):
        operand = kind in OPERANDS or kind == "kw" and value in VALUE_WORDS
        after = pk in OPERANDS and pv != "${" or pk == "kw" and pv in VALUE_WORDS
        depth = len(stack)
        if awaiting and (kind, value) not in (("kw", "catch"), ("kw", "finally")):
            raise Broken("try without a handler", line)
        awaiting = ""
        if depth == 0 and starts and top and value not in top:
            raise Broken("no declaration begins like this", line)
        if not packaged:
            if value != "package":
                raise Broken("no package clause", line)
            packaged = True
        starts = False
        if go and pk == "id" and depth == 0 and value == "." and run == -1:
            raise Broken("qualified package name", line)

        if operand:
            if kind == "id" and pk == "id" and (run > 0) and not (first and lang in ("javascript", "go")):
                run += 1
                shouted = shouted and (value.isupper() or len(value) < 2)
                if js and value not in JS_AFTER and pv not in JS_BEFORE or not js and run > 2 and not shouted and not (go and depth):
                    raise Broken("operands without an operator", line)
                if go and depth == 0 and pv not in ("type", "func"):
                    raise Broken("operands without an operator", line)
            elif after and not (first and lang in ("javascript", "go")):
                joined = pk == "str" and kind == "str" and (c or pv == "`" == value)
                tagged = js and kind == "str" and (value == "`" or pv in ("from", "static", "get", "set"))
                macro = c and (pk == "id" or kind == "id") and (pk == "str" or kind == "str")
                if not (joined or tagged or macro or go and kind == "str" and value == "`"and depth) and not (go and kind == "str" and pk == "id" and depth):
                    raise Broken("operands without an operator", line)
                run = 1 if kind == "id" else 0
            elif pk == "op" and pv in (")", "]") and not (first and lang in ("javascript", "go")):
                if head == "call" and pv == ")" and kind in ("num", "str") and not c:
                    raise Broken("operands without an operator", line)
                if head == "call" and pv == ")" and kind == "id" and lang in ("javascript", "java"):
                    raise Broken("operands without an operator", line)
                if head == "call" and pv == ")" and kind == "id" and c and first and depth and not value.startswith("__"):
                    raise Broken("missing semicolon", line)
                if pv == "]" and js:
                    raise Broken("operands without an operator", line)
                run = 1 if kind == "id" else 0
            else:
                run = 1 if kind == "id" else 0
            if run == 1:
                shouted = value.isupper()
            if go and depth == 0 and pk == "kw" and pv == "package":
                run = -1
        elif kind == "kw":
            run = 0
            if value in ("import", "package", "export") and depth and not (js and value == "import" and pv not in STARTS):
                if js and value == "import":
                    pass
                elif pv != "." and not (c):
                    raise Broken("declaration inside a block", line)
            if value in ("class", "interface", "enum", "record", "struct", "union") and pv != ".":
                classy = True
            soft = js and value in JS_SOFT or pv == "." or java and value in ("record", "sealed", "permits", "yield", "var", "default", "throws")
            if after and not first and value not in INFIX_WORDS and not soft and lang in ("javascript", "java") and pk != "kw" and not (pk == "id" and pv in JS_SOFT) and not (java and pk == "id" and classy):
                if not (java and pk == "id"):
                    raise Broken("statement without an end", line)
            if value == "else" and pv not in (";", "}") and lang in ("java", "c", "go"):
                raise Broken("else without if", line)
            if value == "try" and pv != ".":
                tries.append(depth)
        else:
            run = 0
            if value in ("(", "[", "{", "${"):
                owner = "group"
                if value == "(":
                    if pk == "kw" and pv in CONTROL_WORDS:
                        owner = "control"
                    elif pk == "kw" and pv in ("function", "func"):
                        owner = "function"
                    elif pk in ("id",) or pv in (")", "]") or pk == "kw" and pv in CALLED_WORDS or pk == "str" and stack and stack[-1][2] in ("class", "object"):
                        owner = "call"
                    if pk in ("num", "str") and owner != "call":
                        raise Broken("operands without an operator", line)
                elif value == "{":
                    if pk in ("num", "str") and not (go or c and pk == "str" or java and pk == "num") and not (js and classy):
                        if not (first and js):
                            raise Broken("operands without an operator", line)
                    if js:
                        if classy:
                            owner = "class"
                        elif pk == "op" and pv in ("=", "(", ",", "[", "?", ":", "=>", "&&", "||", "??", "==", "===", "...", "${", "+") and pv != "=>" and not (pv == ":" and stack and stack[-1][2] == "switch"):
                            owner = "object"
                        elif pk == "kw" and pv in ("return", "const", "let", "var", "import", "export", "default", "in", "of", "case", "throw", "new", "typeof", "yield"):
                            owner = "object"
                        elif pv == ")" and head == "control-switch":
                            owner = "switch"
                        else:
                            owner = "block"
                        if pv == ")" and head == "call" and not first and not (stack and stack[-1][2] in ("class", "object")):
                            raise Broken("block without a header", line)
                        if pk == "id" and not classy and not first and pv not in JS_SOFT:
                            raise Broken("operands without an operator", line)
                    elif c:
                        if pk == "kw" and pv in ("const", "static", "int", "char", "return"):
                            raise Broken("operands without an operator", line)
                        owner = "class" if classy else "block"
                    else:
                        owner = "class" if classy else "block"
                    classy = False
                if value == "(" and owner == "control" and pv == "switch":
                    owner = "control-switch"
                if value == "(" and js and prior in ("function", "*") and pk in ("id", "kw"):
                    owner = "function"
                if value == "(" and pk == "id" and java and prior == "@":
                    owner = "annotation"
                stack.append((value, line, owner))
            elif value in PAIRS:
                if not stack:
                    raise Broken("closing delimiter without an opening one", line)
                opener, _, head = stack.pop()
                if opener != PAIRS[value]:
                    raise Broken("mismatched delimiters", line)
                if value == "}" and tries and tries[-1] == len(stack):
                    awaiting = "handler" if js or head != "resources" else ""
                    tries.pop()
                    if java and resources == len(stack) + 1000:
                        awaiting = ""
                if value == "}" and len(stack) == 0:
                    starts = True
            if value == ";" and not stack:
                starts, classy = True, False
            elif value == ";":
                classy = False
            binary = value not in NOT_BINARY
            if binary and value not in (":", ".", "?.", "::") and pk == "op" and pv in OPENED:
                plain = js and pv == "}" and head != "block" or value == "<" and java and pv in STARTS or value == "?" and java
                if not plain and not (java and value in ("->", ">")) and not (go and value == ":"):
                    raise Broken("operator without an operand", line)
            if binary and pk == "op" and pv and pv not in STARTS and pv not in STOPS and pv not in ("(", "[", "{", "${", "++", "--", ":") and value not in (":", "::", "?"):
                loose = java and (pv in (">", ">>", ">>>", "?", "<", "...") or value in (">", ">>", "->")) or c and pv == "*" or go and (pv in ("<-", "...", "*") or value in ("<-",)) or pv == "?" and value == "."
                if not loose:
                    raise Broken("operator without an operand", line)
            if value in STOPS and pk == "op" and pv and pv not in ended:
                raise Broken("operator without an operand", line)
            if value == ";" and pv == "," or value == ";" and pk == "op" and pv == "(" and (not stack or stack[-1][2] != "control"):
                raise Broken("statement without an end", line)
            if value == "@" and lang in ("javascript",) and pv not in STARTS_OR_CLOSED and pk == "op":
                raise Broken("operator without an operand", line)
            if value == "%" and pv == "<" or value == ">" and pv == "%":
                raise Broken("operator without an operand", line)
            if go and value == "@":
                raise Broken("character outside any token", line)
            if pv == "@" and kind == "op" and lang in ("javascript", "java"):
                raise Broken("operator without an operand", line)
        if pv == "@" and kind in ("num", "str"):
            raise Broken("operator without an operand", line)
        if kind == "kw" and value == "try":
            resources = -1
        if pk == "kw" and pv == "try" and value == "(" and java:
            resources = depth + 1000 + 0
            tries = tries[:-1]
        prior, pk, pv, pline = pv, kind, value, line
        if go and first and depth == 0 and kind == "kw" and value in TOP["go"]:
            classy = classy and value != "func"
        if go and depth == 0 and kind == "op" and value == "}":
            starts = True
    if stack:
        raise Broken("premature end", pline)
    if awaiting or tries:
        raise Broken("try without a handler", pline)
    if not packaged:
        raise Broken("no package clause", 1)
    if pk == "op" and pv not in ("", ";", "}", ")", "]", "$}", "++", "--") or pk == "kw" and pv not in VALUE_WORDS | {"return", "break", "continue", "fallthrough", "debugger"} and not (go):
        raise Broken("premature end", pline)
    if lang in ("java", "c") and pk != "op" and pk:
        raise Broken("premature end", pline)


# ------------------------------------------------------------------------------------------------------ Python

#: Reserved words and statement heads of Python.
PY_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield".split()
)
PY_BLOCKS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class"}
PY_SOFT_BLOCKS = {"match", "case"}
PY_VALUES = {"False", "None", "True"}
PY_INFIX = {"and", "or", "in", "is", "if", "else", "for", "as", "not", "import", "from", "async"}
PY_FOLLOWS = {
    "elif": {"if", "elif"},
    "else": {"if", "elif", "for", "while", "except", "async"},
    "except": {"try", "except"},
    "finally": {"try", "except", "else"},
}
PY_LEX = re.compile(
    r"(?:[ \t\f]|\\\r?\n)*(?:(?P<id>[^\W\d]\w*+(?![\"']))|(?P<nl>\r\n|\n|\r)|(?P<com>#[^\r\n]*)"
    r"|(?P<str>(?i:rb|br|tr|rt|fr|rf|[bruft])?(?:\"\"\"|'''|\"|'))"
    r"|(?P<num>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?)"
    r"|(?P<word>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<end>$))"
)
PY_INDENT = re.compile(r"[ \t\f]*")
PY_CLOSE = {
    '"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+'''", re.S),
    '"': re.compile(r'(?:[^"\\\r\n]++|\\\r\n|\\.)*+"', re.S), "'": re.compile(r"(?:[^'\\\r\n]++|\\\r\n|\\.)*+'", re.S),
}
PY_PREFIX = {"+", "-", "~", "*", "**", "@", "...", "not", "lambda", "await", "yield"}


def python_lines(text: str) -> Iterator[tuple[str, list[Token]]]:
    """Logical lines: their indentation and tokens."""
    pos, line, size = 0, 1, len(text)
    if text.startswith("﻿"):
        pos = 1
    stack: list[tuple[str, int]] = []
    tokens: list[Token] = []
    indent, fresh = "", True
    while pos < size:
        if fresh:
            if text[pos] in "<>=|":
                end = text.find("\n", pos)
                if CONFLICT.match(text, pos, size if end < 0 else end):
                    raise Broken("merge-conflict marker", line)
            if not stack:
                m = PY_INDENT.match(text, pos)
                indent, pos = m[0], m.end()
            fresh = False
        m = PY_LEX.match(text, pos)
        if not m:
            raise Broken("character outside any token", line)
        kind = m.lastgroup
        value = m[m.lastindex]
        if kind == "word":
            kind = "id"
        whole = m[0]
        if len(whole) != len(value) and "\\" in whole:
            line += text.count("\n", pos, m.start(kind))  # continued lines
        pos = m.end()
        if kind == "nl":
            line, fresh = line + 1, True
            if not stack and tokens:
                yield indent, tokens
                tokens = []
        elif kind == "end":
            break
        elif kind == "str":
            quote = value.lstrip("rRbBuUfFtT")
            c = PY_CLOSE[quote].match(text, pos)
            if not c:
                raise Broken("unterminated string", line)
            tokens.append(("str", value, line, False))
            line += text.count("\n", pos, c.end())
            pos = c.end()
        elif kind != "com":
            if kind == "num" and stack and tokens[-1][1] == ",":
                run = RUN.match(text, m.start("num"))
                if run:
                    tokens += [("num", value, line, False), ("op", ",", line, False)]
                    line += text.count("\n", pos, run.end())
                    pos = run.end()
                    fresh = text[pos - 1] == "\n"
                    continue
            if kind == "op" and value in "([{":
                stack.append((value, line))
            elif kind == "op" and value in ")]}":
                if not stack:
                    raise Broken("closing delimiter without an opening one", line)
                if stack.pop()[0] != PAIRS[value]:
                    raise Broken("mismatched delimiters", line)
            tokens.append(("kw" if kind == "id" and value in PY_WORDS else kind or "", value, line, False))
    if stack:
        raise Broken("premature end", stack[-1][1])
    if tokens:
        yield indent, tokens


PY_ENDS = {")", "]", "}", ",", ";", ":", "=", ":=", "**=", "//=", ">>=", "<<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@="}
PY_OPEN = {"(", "[", "{", ",", ":", ";", "=", "lambda", "else", "try", "finally", "except", "return", "yield", "pass", "break", "continue", "raise", "import", "*", "/", "...", "print"}
PY_CLOSED = {")", "]", "}", "..."}
PY_EMPTY = {"(", "[", "{", ",", ";", "=", "return"}
PY_ASSIGNS = {"=", "+=", "-=", "*=", "/=", ":="}


def python_operands(tokens: list[Token]) -> None:
    """Operands and operators must alternate within one logical line."""
    pk, pv = "op", ";"
    for kind, value, line, _ in [*tokens, ("op", ";", tokens[-1][2], False)]:
        after = pk in OPERANDS or pv in PY_CLOSED and pk == "op" or pk == "kw" and pv in PY_VALUES
        if kind in OPERANDS:
            if after and not (pk == "str" and kind == "str"):
                raise Broken("operands without an operator", line)
        elif kind == "kw":
            if value in PY_VALUES:
                if after:
                    raise Broken("operands without an operator", line)
            elif after:
                if value not in PY_INFIX:
                    raise Broken("operands without an operator", line)
            elif value in ("and", "or", "is", "in", "as") and pv != "not":
                raise Broken("operator without an operand", line)
        elif value in "([{":
            if after and value == "{":
                raise Broken("operands without an operator", line)
        elif value in PY_ENDS:
            if not after and (pv not in PY_OPEN or value == "," and pv in PY_EMPTY or value == "=" and pv in PY_EMPTY or pk == "op" and value in ";)" and pv in PY_ASSIGNS):
                raise Broken("operator without an operand", line)
        elif not after and value not in PY_PREFIX and not (value == "." and pv in ("from", ".", "import", "...") or value == "/" and pv in ("(", ",") or value == "->"):
            raise Broken("operator without an operand", line)
        pk, pv = kind, value


def python_check(text: str) -> None:
    """Raise ``Broken`` where Python 3 cannot read the text."""
    indents = [""]
    opened: dict[int, str] = {}  # by depth: the head of the last compound statement there
    pending = ""  # a header waits for its block
    last = 1
    for indent, tokens in python_lines(text):
        line = last = tokens[0][2]
        kind, value, _, _ = tokens[0]
        if pending:
            if not indent.startswith(indents[-1]) or indent == indents[-1]:
                raise Broken("header without a block", line)
            indents.append(indent)
            opened.pop(len(indents), None)
        elif indent != indents[-1]:
            if indent.startswith(indents[-1]):
                raise Broken("unexpected indentation", line)
            while len(indents) > 1 and indents[-1] != indent:
                top = opened.pop(len(indents), "")
                if top == "try":
                    raise Broken("try without a handler", line)
                indents.pop()
            if indents[-1] != indent:
                raise Broken("indentation of no open block", line)
        pending = ""
        depth = len(indents)
        head = value if kind == "kw" else ""
        if head == "async" and len(tokens) > 1:
            head = tokens[1][1]
        if kind == "id" and value in PY_SOFT_BLOCKS and tokens[-1][1] == ":" and len(tokens) > 2 and tokens[1][1] not in ("=", ".", ",", ":"):
            head = value
        before = opened.get(depth, "")
        if head in PY_FOLLOWS:
            if before not in PY_FOLLOWS[head]:
                raise Broken("clause without its statement", line)
        elif before == "try":
            raise Broken("try without a handler", line)
        opened[depth] = head if head in PY_BLOCKS or head in PY_SOFT_BLOCKS else ""
        if head in PY_BLOCKS or head in PY_SOFT_BLOCKS:
            at, level, lambdas = 0, 0, 0
            for i, t in enumerate(tokens):
                if t[0] == "op":
                    level += (t[1] in "([{") - (t[1] in ")]}")
                    if t[1] == ":" and not level:
                        if lambdas:
                            lambdas -= 1
                        else:
                            at = i
                            break
                elif t[1] == "lambda" and not level:
                    lambdas += 1
            if not at:
                raise Broken("header without a colon", line)
            if at == len(tokens) - 1:
                pending = head
            body, rest = tokens[:at], tokens[at + 1 :]
            if head in ("def", "class"):
                names = [t for t in body if t[1] not in ("async", "def", "class")]
                if not names or names[0][0] != "id":
                    raise Broken("header without a name", line)
                if head == "def" and (len(names) < 2 or names[1][1] not in ("(", "[")):
                    raise Broken("header without a parameter list", line)
            if head in ("else", "try", "finally") and len(body) > 1 or head in ("if", "elif", "while", "for", "with") and len(body) < 2:
                raise Broken("malformed header", line)
            if head == "for" and not any(t[1] == "in" for t in body):
                raise Broken("for without in", line)
            skip = 2 if body[0][1] == "async" else 1
            for part in (body[skip:], rest):
                if part:
                    python_operands(part)
            if head in ("match", "case"):
                continue
        elif head in ("import", "from"):
            if head == "from" and not any(t[1] == "import" for t in tokens) or len(tokens) < 2 or tokens[-1][1] in ("import", ".", ","):
                raise Broken("malformed import", line)
            if head == "from":
                k = next(i for i, t in enumerate(tokens) if t[1] == "import")
                if k == len(tokens) - 1 or any(t[0] in ("num", "str") for t in tokens):
                    raise Broken("malformed import", line)
                python_operands([t for t in tokens[k + 1 :] if t[1] not in ("(", ")")] or tokens[k:])
            else:
                python_operands(tokens[1:])
        elif head in ("assert", "del", "return", "raise", "global", "nonlocal", "await", "not", "yield", "lambda", "pass", "break", "continue") or head in PY_VALUES or not head:
            if head in ("pass", "break", "continue") and len(tokens) > 1 and tokens[1][1] != ";":
                raise Broken("operands without an operator", line)
            if head in ("assert", "del", "global", "nonlocal") and len(tokens) < 2:
                raise Broken("statement without an operand", line)
            if kind == "op" and value == "@":
                python_operands(tokens[1:])
            elif kind == "id" and value == "type" and len(tokens) > 3 and tokens[1][0] == "id":
                python_operands(tokens[1:])
            else:
                python_operands(tokens[1:] if head and head not in PY_VALUES and head not in ("not", "lambda", "await", "yield") and len(tokens) > 1 else tokens)
            if head == "raise":
                level = 0
                for t in tokens:
                    level += (t[1] in "([{") - (t[1] in ")]}") if t[0] == "op" else 0
                    if t[1] == "," and not level:
                        raise Broken("malformed raise", line)
            for i, t in enumerate(tokens):
                if t[0] == "kw" and t[1] == "for" and (i == 0 or not any(u[1] == "in" for u in tokens[i:])):
                    raise Broken("for without in", line)
        else:
            raise Broken("no statement begins like this", line)
    if pending:
        raise Broken("header without a block", last)
    if "try" in opened.values():
        raise Broken("try without a handler", last)


# ------------------------------------------------------------------------------------------------------- shell

SH_META = set(" \t\n;&|<>()")
#: Reserved words of the shell after which a command begins, and the words that close what others open.
SH_OPENERS = {"if": "fi", "while": "done", "until": "done", "for": "done", "select": "done", "case": "esac", "{": "}"}
SH_MIDDLE = {"then": "if", "elif": "if", "else": "if", "do": "loop"}


class Shell:
    """One pass over a script with a stack of open constructs."""

    def __init__(self, text: str) -> None:
        self.text, self.pos, self.line = text.replace("\r\n", "\n"), 0, 1
        self.heredocs: list[tuple[str, bool]] = []

    def fail(self, kind: str) -> None:
        raise Broken(kind, self.text.count("\n", 0, self.pos) + 1)

    def quoted(self, quote: str) -> None:
        """Behind an opening quote, go behind the closing one."""
        t, size = self.text, len(self.text)
        while self.pos < size:
            c = t[self.pos]
            if c == quote:
                self.pos += 1
                return
            if quote == "'":
                self.pos += 1
            elif c == "\\":
                self.pos += 2
            elif c == "`" and quote == '"':
                self.pos += 1
                self.quoted("`")
            elif c == "$" and quote in '"`':
                self.dollar()
            else:
                self.pos += 1
        self.fail("unterminated string")

    def dollar(self) -> None:
        t = self.text
        if t.startswith("$((", self.pos):
            self.pos += 3
            self.balanced("((", "))")
        elif t.startswith("$(", self.pos):
            self.pos += 2
            self.commands(")")
        elif t.startswith("${", self.pos):
            self.pos += 2
            self.braces()
        else:
            self.pos += 1

    def braces(self) -> None:
        t, size = self.text, len(self.text)
        while self.pos < size:
            c = t[self.pos]
            if c == "}":
                self.pos += 1
                return
            if c in "'\"`":
                self.pos += 1
                self.quoted(c)
            elif c == "$":
                self.dollar()
            else:
                self.pos += 2 if c == "\\" else 1
        self.fail("premature end")

    def balanced(self, opener: str, closer: str) -> None:
        """Arithmetic: parentheses inside must balance."""
        t, size, depth = self.text, len(self.text), 0
        while self.pos < size:
            c = t[self.pos]
            if depth == 0 and t.startswith(closer, self.pos):
                self.pos += len(closer)
                return
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth < 0:
                    self.fail("mismatched delimiters")
            elif c in "'\"`":
                self.pos += 1
                self.quoted(c)
                continue
            elif c == "$":
                self.dollar()
                continue
            self.pos += 2 if c == "\\" else 1
        self.fail("premature end")

    def word(self) -> str:
        """Read one word; what it looks like unquoted."""
        t, size, began = self.text, len(self.text), self.pos
        plain = True
        while self.pos < size:
            c = t[self.pos]
            if c in SH_META:
                if c == "(" and self.pos > began and t[self.pos - 1] in "@?*+!" and plain:
                    self.pos += 1
                    self.balanced("(", ")")
                    continue
                if c in "<>" and t.startswith("(", self.pos + 1) and self.pos == began:
                    self.pos += 2
                    self.commands(")")
                    continue
                break
            if c == "\\":
                self.pos += 2
                plain = False
            elif c in "'\"`":
                self.pos += 1
                self.quoted(c)
                plain = False
            elif c == "$":
                if t.startswith("$'", self.pos):
                    self.pos += 2
                    while self.pos < size and t[self.pos] != "'":
                        self.pos += 2 if t[self.pos] == "\\" else 1
                    if self.pos >= size:
                        self.fail("unterminated string")
                    self.pos += 1
                else:
                    self.dollar()
                plain = False
            else:
                self.pos += 1
        return t[began : self.pos] if plain else "\0"

    def newline(self) -> None:
        """At a line end: read the bodies of here-documents."""
        self.pos += 1
        for mark, dash in self.heredocs:
            while True:
                if self.pos >= len(self.text):
                    return  # the shell takes the end of the file as the end of the document
                end = self.text.find("\n", self.pos)
                end = len(self.text) if end < 0 else end
                body = self.text[self.pos : end]
                self.pos = min(end + 1, len(self.text))
                if (body.lstrip("\t") if dash else body) == mark:
                    break
        self.heredocs = []

    def commands(self, until: str) -> None:
        """Read a list of commands up to the closing token ``until`` ("" for the end of the text)."""
        t, size = self.text, len(self.text)
        stack: list[list[str]] = []  # construct, state
        fresh, joined, named = True, False, False  # a command may begin; an operator asks for one; a command was read
        pattern = False  # inside a case, before a pattern
        while True:
            while self.pos < size and t[self.pos] in " \t":
                self.pos += 1
            if t.startswith("\\\n", self.pos):
                self.pos += 2
                continue
            if self.pos >= size:
                if until or stack or joined:
                    self.fail("premature end")
                return
            c = t[self.pos]
            if c == "#":
                end = t.find("\n", self.pos)
                self.pos = size if end < 0 else end
                continue
            if c == "\n":
                self.newline()
                fresh, named = True, False
                continue
            if pattern:
                if t.startswith("esac", self.pos) and (self.pos + 4 >= size or t[self.pos + 4] in SH_META):
                    self.pos += 4
                    stack.pop()
                    pattern, fresh, named = False, False, True
                    continue
                if c == "(":
                    self.pos += 1
                read = False
                while True:
                    while self.pos < size and t[self.pos] in " \t":
                        self.pos += 1
                    if self.pos >= size:
                        self.fail("premature end")
                    if t[self.pos] == "|":
                        self.pos += 1
                        read = False
                        continue
                    if t[self.pos] == ")" and read:
                        self.pos += 1
                        break
                    if t[self.pos] in SH_META or read:
                        self.fail("malformed case pattern")
                    self.word()
                    read = True
                pattern, fresh, named, joined = False, True, False, False
                continue
            if c == ")":
                if stack and stack[-1][0] == "(":
                    if joined or stack[-1][1] == "empty" and not named:
                        self.fail("mismatched delimiters")
                    stack.pop()
                    self.pos += 1
                    fresh, named = False, True
                    continue
                if until == ")" and not stack:
                    self.pos += 1
                    return
                self.fail("closing delimiter without an opening one")
            if c in ";&|":
                two = t[self.pos : self.pos + 2]
                if two in (";;", ";&"):
                    if not stack or stack[-1][0] != "case":
                        self.fail("clause without its statement")
                    self.pos += 3 if t.startswith(";;&", self.pos) else 2
                    pattern, fresh, named = True, True, False
                    continue
                if fresh and not named:
                    self.fail("operator without a command")
                if two == "&>":
                    self.pos += 3 if t.startswith("&>>", self.pos) else 2
                    self.target()
                    continue
                self.pos += 2 if two in ("&&", "||", "|&") else 1
                joined = two in ("&&", "||", "|&") or c == "|"
                fresh, named = True, False
                continue
            if c in "<>":
                m = re.compile(r"<<<|<<-?|<>|<&|>&|>>|>\||[<>]").match(t, self.pos)
                assert m
                if m[0] in ("<", ">") and t.startswith("(", m.end()):
                    self.word()
                    fresh, named, joined = False, True, False
                    continue
                self.pos = m.end()
                if m[0] in ("<<", "<<-"):
                    while self.pos < size and t[self.pos] in " \t":
                        self.pos += 1
                    if self.pos >= size or t[self.pos] in SH_META:
                        self.fail("operator without an operand")
                    began = self.pos
                    self.word()
                    self.heredocs.append((re.sub(r"[\"'\\]", "", t[began : self.pos]), m[0] == "<<-"))
                else:
                    self.target()
                named, joined = True, False
                continue
            if c == "(":
                if t.startswith("((", self.pos) and fresh and not named:
                    self.pos += 2
                    self.balanced("((", "))")
                    fresh, named, joined = False, True, False
                    continue
                if not fresh or named:
                    self.fail("unexpected parenthesis")
                stack.append(["(", "empty"])
                self.pos += 1
                joined = False
                continue
            began = self.pos
            w = self.word()
            if self.pos == began:
                self.fail("character outside any token")
            if re.fullmatch(r"\d+", w) and self.pos < size and t[self.pos] in "<>":
                continue
            if fresh and not named:
                joined = False
                if w in ("if", "while", "until"):
                    stack.append([w, "condition"])
                    joined = True
                    continue
                if w in ("for", "select"):
                    stack.append([w, "condition"])
                    while self.pos < size and t[self.pos] in " \t":
                        self.pos += 1
                    if t.startswith("((", self.pos):
                        self.pos += 2
                        self.balanced("((", "))")
                        fresh, named = False, True
                        continue
                    name = self.word()
                    if not re.fullmatch(r"[A-Za-z_]\w*", name):
                        self.fail("for without a name")
                    fresh, named = False, True
                    continue
                if w == "case":
                    while self.pos < size and t[self.pos] in " \t":
                        self.pos += 1
                    if self.pos >= size or t[self.pos] in SH_META:
                        self.fail("premature end")
                    self.word()
                    m = re.compile(r"[ \t\n]*in(?=[ \t\n]|$)").match(t, self.pos)
                    if not m:
                        self.fail("case without in")
                        return
                    self.pos = m.end()
                    stack.append(["case", ""])
                    pattern, fresh = True, True
                    continue
                if w in ("then", "elif", "else", "do"):
                    top = stack[-1] if stack else ["", ""]
                    fits = {"then": top[0] == "if" and top[1] == "condition", "elif": top == ["if", "then"], "else": top == ["if", "then"], "do": top[0] in ("while", "until", "for", "select") and top[1] == "condition"}[w]
                    if not fits:
                        self.fail("clause without its statement")
                    top[1] = {"then": "then", "elif": "condition", "else": "else", "do": "do"}[w]
                    joined = True
                    continue
                if w in ("fi", "done", "esac", "}"):
                    top = stack[-1] if stack else ["", ""]
                    if SH_OPENERS.get(top[0]) != w or w in ("fi", "done") and top[1] == "condition":
                        self.fail("mismatched delimiters")
                    if top[1] in ("fresh",):
                        self.fail("empty block")
                    stack.pop()
                    fresh, named = False, True
                    continue
                if w == "{":
                    stack.append(["{", ""])
                    joined = True
                    continue
                if w == "!" or w == "time":
                    continue
                if w == "[[":
                    end = re.compile(r"[ \t\n]\]\](?=[\s;&|)]|$)").search(t, self.pos)
                    if not end:
                        self.fail("premature end")
                        return
                    while self.pos < end.start():
                        if t[self.pos] in "'\"`":
                            q = t[self.pos]
                            self.pos += 1
                            self.quoted(q)
                        elif t[self.pos] == "$":
                            self.dollar()
                        else:
                            self.pos += 1
                        if self.pos > end.start():
                            end = re.compile(r"[ \t\n]\]\](?=[\s;&|)]|$)").search(t, self.pos)
                            if not end:
                                self.fail("premature end")
                                return
                    self.pos = end.end()
                    fresh, named = False, True
                    continue
                if w == "function":
                    while self.pos < size and t[self.pos] in " \t":
                        self.pos += 1
                    self.word()
                    m = re.compile(r"[ \t]*(?:\([ \t]*\))?\s*(?=[{(])").match(t, self.pos)
                    if not m:
                        self.fail("function without a body")
                        return
                    self.pos = m.end()
                    continue
                m = re.compile(r"[ \t]*\([ \t]*\)\s*").match(t, self.pos)
                if m and w != "\0":
                    self.pos = m.end()
                    if not re.compile(r"\{[\s]|\(|if\s|for\s|while\s|case\s|\[\[").match(t, self.pos):
                        self.fail("function without a body")
                    continue
            if self.pos < size and t[self.pos] == "(" and t[self.pos - 1] == "=" and re.fullmatch(r"[A-Za-z_]\w*(\[[^\]]*\])?\+?=", t[began : self.pos]):
                self.pos += 1
                self.array()
            fresh, named = False, True
            joined = False

    def array(self) -> None:
        t, size = self.text, len(self.text)
        while self.pos < size:
            c = t[self.pos]
            if c == ")":
                self.pos += 1
                return
            if c in " \t\n":
                self.pos += 1
            elif c == "#":
                end = t.find("\n", self.pos)
                self.pos = size if end < 0 else end
            elif c in ";&|<>(":
                self.fail("mismatched delimiters")
            else:
                self.word()
        self.fail("premature end")

    def target(self) -> None:
        t, size = self.text, len(self.text)
        while self.pos < size and t[self.pos] in " \t":
            self.pos += 1
        if self.pos >= size or t[self.pos] in "\n;&|<>)(" and not (t[self.pos] in "<>" and t.startswith("(", self.pos + 1)):
            self.fail("operator without an operand")
        self.word()


def shell_check(text: str) -> None:
    """Raise ``Broken`` where the shell would report a syntax error. A here-document may end with the file."""
    Shell(text).commands("")


CHECKS = {"python": python_check, "bash": shell_check} | {x: (lambda text, x=x: brace_check(x, text)) for x in LEX}


#: Levels of nesting and bytes of stack for files that exceed the interpreter's usual recursion.
DEEPEST, STACK = 200_000, 512 << 20


def deep(check: Callable[[str], None], text: str) -> None:
    """``check`` on a thread with a large stack; what is nested deeper still isn't judged."""
    result: list[Broken] = []

    def run() -> None:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(DEEPEST)
        try:
            check(text)
        except Broken as x:
            result.append(x)
        except RecursionError:
            pass
        finally:
            sys.setrecursionlimit(before)

    size = threading.stack_size(STACK)
    try:
        thread = threading.Thread(target=run)
        thread.start()
    finally:
        threading.stack_size(size)
    thread.join()
    if result:
        raise result[0]


def syntax_fault(lang: str, text: str) -> tuple[str, int] | None:
    """What keeps ``text`` from being ``lang`` and on which line; None if nothing was found."""
    try:
        try:
            CHECKS[lang](text)
        except RecursionError:
            deep(CHECKS[lang], text)
    except Broken as x:
        return x.kind, x.line
    return None


def language_column(file: Column) -> Column:
    """The language whose syntax the extension of ``file`` asks for; null for others."""
    extension = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension)


def syntax_faults(files: DataFrame, id_col: str = "file_id", file_col: str = "file", text_col: str = "content") -> DataFrame:
    """``(id, lang, fault, line)`` of every distinct row with a text and a known extension; ``fault`` is null where none was found.

    Null texts and files of other extensions are left out; an empty text is valid in every language but Go, which needs a
    package clause. Rows that repeat the same id, file and text count once; other columns of the input are ignored.
    """
    rows = files.select(F.col(id_col).alias("id"), language_column(F.col(file_col)).alias("lang"), F.col(text_col).alias("text"))
    rows = spread(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [syntax_fault(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.int32())], ["id", "lang", "fault", "line"]
            )

    kind = files.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, fault string, line int").dropDuplicates(["id", "lang", "fault", "line"])


def invalid_files(files: DataFrame, id_col: str = "file_id", file_col: str = "file", text_col: str = "content") -> DataFrame:
    """Ids of the files that cannot be parsed in the language of their extension, each once."""
    found = syntax_faults(files, id_col, file_col, text_col).where("fault is not null")
    return found.select(F.col("id").alias(id_col)).distinct()


def invalid_rates(files: DataFrame, by: list[str], id_col: str = "file_id", file_col: str = "file", text_col: str = "content") -> DataFrame:
    """Per value of ``by`` and language: files checked, files that do not parse and their rate.

    A null repository is read from the path, which begins with it; other nulls, and bare names, are one group, the empty string.
    """
    known = {"repo": F.coalesce("repo", F.nullif(F.regexp_extract(file_col, r"^([^/\\]+)[/\\]", 1), F.lit("")))} if "repo" in files.columns else {}
    keys = [F.coalesce(known.get(x, F.col(x)), F.lit("")).alias(f"key_{i}") for i, x in enumerate(by)]
    groups = files.select(F.col(id_col).alias("id"), *keys).dropDuplicates(["id"])
    faults = syntax_faults(files, id_col, file_col, text_col).groupBy("id", "lang").agg(F.max(F.col("fault").isNotNull()).alias("broken"))
    out = groups.join(faults, "id").groupBy(*[f"key_{i}" for i in range(len(by))], "lang")
    out = out.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("broken").cast("bigint")).alias("broken"))
    return out.select(*[F.col(f"key_{i}").alias(x) for i, x in enumerate(by)], "lang", "files", "broken", (F.col("broken") / F.col("files")).alias("rate"))
