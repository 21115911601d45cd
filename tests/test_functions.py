import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions import text as fx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_names(spark):
    assert one(spark, "getHTTPUser_id2 a", fx.words) == ["get", "httpuser", "id2"]
    assert one(spark, "src/a/B.TSX", fx.language_of) == "typescript"
    assert one(spark, "a/src/core/x.py", fx.module_of) == "core"
    assert one(spark, "x.py", fx.module_of) == "root"
    assert one(spark, "a/{b => c}/d.py", fx.renamed_path) == "a/c/d.py"
    assert one(spark, "old.py => new.py", fx.renamed_path) == "new.py"
    assert one(spark, "latest", lambda c: fx.is_test(c, F.lit("a/b.py"))) is True
    assert one(spark, "_x", lambda c: fx.is_private(c, F.lit("python"))) is True
    assert one(spark, "__x", lambda c: fx.is_private(c, F.lit("python"))) is False
    assert one(spark, "run", lambda c: fx.is_private(c, F.lit("go"))) is True


def test_texts(spark):
    assert one(spark, "a" * 41, fx.preview) == "a" * 37 + "..."
    assert one(spark, "aabb", fx.entropy) == 1.0
    assert one(spark, "", fx.entropy) == 0.0
    assert one(spark, "'''a'b'''", fx.unquoted) == "a'b"
    assert one(spark, "/* one\n * two */", fx.comment_text) == "one two"
    assert one(spark, '<a b="c">', fx.html_escaped) == "&lt;a b=&quot;c&quot;&gt;"
    assert one(spark, "x = 1\n\n# no\n  // no\ny", fx.code_lines) == 2
    assert one(spark, "03.02.2024", fx.any_date).day == 3
    assert one(spark, "never", fx.any_date) is None
    assert one(spark, None, fx.entropy) == 0.0


def test_spread_texts(spark):
    assert one(spark, "parseUser_id", fx.spread_name) == "parse User id"
    assert one(spark, "def f():\n  a\n  b", lambda c: fx.signature(c, F.lit(1))) == "def f():"
    assert one(spark, "\n".join("abcdefghijklmnopq"), fx.snippet).endswith("\n    # ... (3 more lines)")


@settings(max_examples=150, deadline=None)
@given(st.text("ab*?[].!/", max_size=8), st.text("ab./", max_size=8))
def test_glob_is_like_fnmatch(pattern, name):
    if "[" in pattern:
        return
    assert bool(re.match(fx.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_ignore_patterns():
    assert re.match(fx.ignore_regex("/build/"), "build/x.py")
    assert not re.match(fx.ignore_regex("/build/"), "a/build/x.py")
    assert re.match(fx.ignore_regex("*.log"), "a/b.log")
    assert re.match(fx.ignore_regex("a/**/z.py"), "a/b/c/z.py")


def test_snippets_and_encoder_text(spark):
    long = "def f(a,\n      b):\n" + "\n".join(f"    x{i} = {i}" for i in range(20))
    row = spark.createDataFrame([("fooBar_baz", long), ("g", "x\ny")], "n string, t string").select(fx.snippet(F.col("t")).alias("s"), fx.semantic_text(F.col("n"), F.col("t")).alias("e"), fx.head_lines(F.col("t")).alias("h")).collect()
    assert row[0].h == 2 and row[0].s.count("\n") == 14 and row[0].s.endswith("    x11 = 11\n    # ... (8 more lines)") and row[1].s == "x\ny" and row[1].h == 1
    assert row[0].e.split("\n")[:3] == ["fooBar_baz foo bar baz", "def f(a,", "      b):"] and row[0].e.count("\n") == 7
    short = spark.createDataFrame([("a {\n" + "b\n" * 30,)], "t string").select(fx.snippet(F.col("t"), 2)).first()[0]
    assert short == "a {\n    # ..."


def test_small_helpers(spark):
    assert [fx.seconds(x) for x in ("90s", "30m", "1h", "7", "")] == [90, 1800, 3600, 7, 0]
    assert fx.thresholds("a=1.5, b=2") == {"a": 1.5, "b": 2.0}
    rows = spark.createDataFrame([(9.0, 10.0), (0.5, 10.0), (5.0, 0.0)], "s double, m double").select(fx.decile(F.col("s"), F.col("m")).alias("d"), fx.project_key(F.lit("/a")).alias("k")).collect()
    assert [r.d for r in rows] == ["critical", "optimal", "optimal"] and len(rows[0].k) == 64
