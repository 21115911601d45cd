import datetime
import json

from pyspark.sql import functions as F

from quarrylens.plans import quality
from quarrylens.sinks import formats
from quarrylens.sources import logs, tree
from quarrylens.streaming import changes

SHA = "a" * 40


def lines(spark, text):
    return logs.text_lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")


def test_numstat(spark):
    found = logs.numstat(lines(spark, f"{SHA}\n3\t1\ta.py\n-\t-\tb.png\n{'b' * 40}\n1\t0\ta.py")).collect()
    assert [(r.commit[0], r.file, r.added, r.removed) for r in found] == [("a", "a.py", 3, 1), ("a", "b.png", None, None), ("b", "a.py", 1, 0)]


def test_log_and_blame(spark):
    row = logs.one_line_log(lines(spark, f"{SHA}|Ann|a@x|1700000000|fix | this")).first()
    assert row.subject == "fix | this" and row.author == "Ann"
    text = f"{SHA} 1 1 2\nauthor Ann\nauthor-mail <a@x>\nauthor-time 1700000000\nsummary s\n\tone\n{SHA} 2 2\n\ttwo"
    assert [(r.line, r.author, r.email) for r in logs.porcelain_blame(lines(spark, text)).orderBy("line").collect()] == [(1, "Ann", "a@x"), (2, "Ann", "a@x")]
    hunk = logs.diff_hunks(lines(spark, "@@ -1,2 +3,4 @@\n+x")).orderBy("pos").collect()[-1]
    assert (hunk.start, hunk.lines) == (3, 4)


def test_parts_of_a_second_are_rounded_as_in_sql(spark, tmp_path):
    from oracle import connect

    rows = [(f"{i:040x}", "r", f"f{i}.py", 1, 0, "Ann", datetime.datetime(2024, 1, 1, 0, 0, i, part)) for i, part in enumerate((0, 400_000, 500_000, 500_000, 999_999))]
    spark.createDataFrame(rows, "commit_hash string, repo string, file string, added long, removed long, author string, ts timestamp").write.parquet(str(tmp_path / "commit_files.parquet"))
    db = connect(tmp_path / "none")
    db.execute(f"create view commit_files as select * from '{tmp_path}/commit_files.parquet/*.parquet'")
    ours = sorted(map(tuple, quality.one_line_log(spark, str(tmp_path)).collect()))
    assert ours == sorted(db.execute(quality.SQL["one_line_log"]).fetchall()) and [x[3] % 60 for x in ours] == [0, 1, 2, 4, 5]


def test_stack_frames(spark):
    text = 'File "src/app.py", line 42, in main | File "src/app.py", line 42, in main\n at x(App.java:15)\n/lib/u.rb:25:in `p\'\nmain.go:7'
    found = logs.stack_frames(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("pos").collect()
    assert [(r.style, r.file, r.line) for r in found] == [("python", "src/app.py", 42), ("java", "App.java", 15), ("ruby", "/lib/u.rb", 25), ("generic", "main.go", 7)]
    files = spark.createDataFrame([("x/src/app.py",), ("y/App.java",), ("z/app.py",)], "file string")
    local = {r.file: r.local for r in logs.local_file(spark.createDataFrame(found), files).collect()}
    assert local["src/app.py"] == "x/src/app.py" and local["App.java"] == "y/App.java" and local["main.go"] is None
    kind, message = logs.error_of(F.col("t"))
    row = spark.createDataFrame([("x\nZeroDivisionError: by zero",)], "t string").select(kind.alias("k"), message.alias("m")).first()
    assert (row.k, row.m) == ("ZeroDivisionError", "by zero")


def test_traces_of_six_languages(spark):
    traces = {
        "python": 'Traceback (most recent call last):\n  File "a/b.py", line 3, in <module>\n    go()\nshop.errors.StockError: none left: 2',
        "java": 'Exception in thread "main" java.lang.IllegalStateException: shut\n\tat com.x.Gate.open(Gate.java:17)\n\tat com.x.Main$1.run(Main.kt:5)',
        "node": "TypeError: x is not a function\n    at Object.run (/srv/app/run.js:10:15)\n    at async load (file:///srv/app/load.mjs:4:2)\n    at /srv/app/top.js:1:1",
        "go": "panic: runtime error: index out of range [3]\n\ngoroutine 1 [running]:\nmain.main()\n\t/w/main.go:9 +0x1d",
        "rust": "thread 'main' panicked at src/main.rs:4:5:\nout of ink\nstack backtrace:\n   1: pen::draw\n             at ./src/pen.rs:12:9",
        "ruby": "app.rb:3:in `draw': no paper (PaperError)\n\tfrom lib/run.rb:8:in `block in main'",
    }
    df = spark.createDataFrame(list(traces.items()), "id string, t string")
    got = {(r.id, r.style, r.file, r.line, r.function) for r in logs.stack_frames(df, "id", "t").collect()}
    assert got >= {
        ("python", "python", "a/b.py", 3, "<module>"), ("java", "java", "Gate.java", 17, "com.x.Gate.open"), ("java", "java", "Main.kt", 5, "com.x.Main$1.run"), ("node", "node", "/srv/app/run.js", 10, "Object.run"),
        ("node", "node", "/srv/app/load.mjs", 4, "load"), ("node", "node", "/srv/app/top.js", 1, None), ("go", "go", "/w/main.go", 9, None), ("rust", "rust", "src/main.rs", 4, None), ("rust", "rust", "./src/pen.rs", 12, None),
        ("ruby", "ruby", "app.rb", 3, "draw"), ("ruby", "ruby", "lib/run.rb", 8, "main"),
    }
    kind, message = logs.error_of(F.col("t"))
    errors = {r.id: (r.k, r.m) for r in df.select("id", kind.alias("k"), message.alias("m")).collect()}
    assert errors == {
        "python": ("StockError", "none left: 2"), "java": ("IllegalStateException", "shut"), "node": ("TypeError", "x is not a function"), "go": (None, "index out of range [3]"), "rust": (None, "out of ink"), "ruby": ("PaperError", "no paper"),
    }


def test_other_logs(spark):
    rows = logs.function_log(lines(spark, f"{SHA}|Ann|a@x|1700000000|fix | this\n@@ -1 +1 @@\n-a\n{'b' * 40}|Bob|b@x|1700000001|more\n+c")).collect()
    assert [(r.commit[0], r.author, r.line) for r in rows] == [("a", "Ann", "@@ -1 +1 @@"), ("a", "Ann", "-a"), ("b", "Bob", "+c")] and rows[0].subject == "fix | this"
    rows = logs.dated_commits(lines(spark, f"{SHA} 2024-02-29 10:00:00 +0100\nnone\n{'b' * 7} 2024-13-01")).collect()
    assert [(r.commit[0], str(r.day)) for r in rows] == [("a", "2024-02-29"), ("b", "None")]
    rows = logs.author_counts(lines(spark, "  12\tAnn Lee <a@x>\n3 Bob\nnobody")).collect()
    assert [(r.commits, r.author, r.email) for r in rows] == [(12, "Ann Lee", "a@x"), (3, "Bob", None)]
    rows = logs.rename_log(lines(spark, f"{SHA}\nM\tx.py\nR087\told.py\tnew.py\nC100\ta\tb")).collect()
    assert [(r.commit[0], r.old, r.new, r.score) for r in rows] == [("a", "old.py", "new.py", 87), ("a", "a", "b", 100)]
    found = logs.numstat(lines(spark, f"commit: {SHA}|Ann\n3\t1\ta.py\n@@{'b' * 40}\n1\t0\tb.py")).collect()
    assert [(r.commit[0], r.file) for r in found] == [("a", "a.py"), ("b", "b.py")]
    assert logs.rename_log(lines(spark, "")).count() == 0


def test_settings(spark):
    rows = spark.createDataFrame([(1, "# no=comment\nkey = 'long value'\nurl: http://a=b\nshort=x")], "id int, t string")
    assert [(r.line, r.key, r.value) for r in logs.key_values(rows, "id", "t").collect()] == [(2, "key", "long value")]
    rows = spark.createDataFrame([(1, json.dumps({"a": {"b": ["x", 1]}, "c": "y"})), (2, "no json"), (3, None)], "id int, t string")
    assert {(r.path, r.value) for r in logs.json_values(rows, "id", "t").collect()} == {("a.b[0]", "x"), ("c", "y")}


def test_scan(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "src/b.js": "let a", "node_modules/c.js": "no", ".git/d.py": "no", "src/e.txt": "no", "src/gen/f.py": "no", "big.py": "x" * 1_000_001}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = tree.scan(spark, f"file:{tmp_path}", ["gen/", "# comment"]).collect()
    assert {(r.file, r.language, r.content) for r in found} == {("a.py", "python", "x = 1"), ("src/b.js", "javascript", "let a")}
    assert {r.file for r in tree.scan(spark, f"file:{tmp_path}", ["*.py", "!a.py"], content=False).collect()} == {"a.py", "src/b.js"}
    assert {r.file for r in tree.scan(spark, f"file:{tmp_path}", ["!a.py", "*.py"], content=False).collect()} == {"src/b.js"}


def test_text_files_and_stale_ones(spark, tmp_path):
    for name, text in {"a.env": "K=1", "sub/b.json": "{}", ".hid/c.env": "x", "venv/d.env": "x", "e.py": "x = 1", "big.env": "x" * ((1 << 20) + 1)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.file, r.content) for r in tree.text_files(spark, f"file:{tmp_path}", ["*.env", "*.json"]).collect()} == {("a.env", "K=1"), ("sub/b.json", "{}")}
    known = tree.scan(spark, f"file:{tmp_path}", content=False).select("file", "size", "modified")
    known = spark.createDataFrame(known.collect(), known.schema)
    assert tree.stale(spark, f"file:{tmp_path}", known).count() == 0
    (tmp_path / "e.py").write_text("x = 12")
    (tmp_path / "f.py").write_text("y")
    assert {(r.file, r.change) for r in tree.stale(spark, f"file:{tmp_path}", known).collect()} == {("e.py", "modified"), ("f.py", "added")}


def test_python_facts():
    text = 'import os\nclass A:\n    """doc"""\n    @property\n    def f(self, host, port: Port):\n        # say hello\n        if host and port:\n            return self.g("a value", 42)\n'
    found = tree.python_facts("a.py", text)
    by = lambda kind: [x for x in found if x["fact"] == kind]
    assert [(x["name"], x["kind"], x["parent"]) for x in by("entity")] == [("A", "class", None), ("f", "function", "A")]
    assert by("entity")[1]["complexity"] == 3 and by("entity")[1]["decorated"]
    assert {x["name"] for x in by("param")} == {"host", "port"}
    assert ("g", "A") in {(x["name"], x.get("parent")) for x in by("reference")}
    assert {x["text"] for x in by("literal")} == {"a value", "42"}
    assert by("comment")[0]["name"] == "if host and port:"
    assert tree.python_facts("a.py", "def (") == []


def test_facts_of_nothing(spark):
    rows = spark.createDataFrame([("a.py", None), ("b.js", "function f() { g(1, 'x'); }"), ("c.unknown", "x"), (None, "x")], "file string, content string")
    assert {r.file for r in tree.facts(rows).collect()} == {"b.js"}


def test_flags_round_trip(spark):
    files = spark.createDataFrame([("a.py", "x\n  y\nz"), ("b.py", "w")], "file string, content string")
    flags = spark.createDataFrame([("a.py", 2, "bad"), ("a.py", 2, "worse")], "file string, line int, note string")
    marked = formats.flagged(files, flags)
    assert marked.first().content == "x\n  # [FLAG] bad; worse\n  y\nz" and marked.count() == 1
    assert formats.unflagged(marked).first().content == "x\n  y\nz"
    java = spark.createDataFrame([("A.java", "a\n// [FLAG] old\nb")], "file string, content string")
    flags = spark.createDataFrame([("A.java", 2, "bad")], "file string, line int, note string")
    assert formats.flagged(java, flags, replace=True).first().content == "a\n// [FLAG] bad\nb"
    assert formats.flag_report(java, flags).first().asDict() == {"file": "A.java", "flags": 1, "lines_before": 3, "lines_after": 4}


def test_files_are_written_with_backup(spark, tmp_path):
    new, old = (spark.createDataFrame([("src/a.py", x)], "file string, content string") for x in ("new\r\n", "old"))
    formats.write_files(new, str(tmp_path), old)
    assert (tmp_path / "src/a.py").read_bytes() == b"new\r\n" and (tmp_path / "src/a.py.bak").read_text() == "old"
    rows = formats.as_tree(spark.createDataFrame([("r/s/a.py",), ("r/b.py",)], "file string"), "file").orderBy("path").collect()
    assert [r.value for r in rows] == ["r/ (2)", "  b.py", "  s/ (1)", "    a.py"]
    row = spark.createDataFrame([("k = 'abc' + abc", "abc")], "l string, v string").select(formats.redacted_line(F.col("l"), F.col("v")).alias("x")).first()
    assert row.x == "k = '***REDACTED***' + abc"


def events(spark):
    rows = [("a.py", "created", 0), ("a.py", "modified", 499), ("b.py", "created", 600), ("b.py", "deleted", 700), ("a.py", "deleted", 5000)]
    return spark.createDataFrame([(p, c, t) for p, c, t in rows], "path string, change string, ms long").select("path", "change", F.timestamp_millis("ms").alias("ts"))


def test_debounce(spark):
    found = {(r.batch, r.path, r.change) for r in changes.debounced(events(spark)).collect()}
    assert found == {(1, "a.py", "modified"), (2, "a.py", "deleted")}


def test_moves_and_filters(spark):
    rows = spark.createDataFrame([("a.py", "moved", 1, "b.py"), ("node_modules/x.js", "modified", 1, None), ("c.txt", "modified", 1, None), ("d.py", "modified", 2_000_000, None)], "path string, change string, size long, target string").withColumn("ts", F.current_timestamp())
    assert {(r.path, r.change) for r in changes.watched(rows).collect()} == {("a.py", "deleted"), ("b.py", "created")}


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(source)
    later = spark.createDataFrame([("z.py", "modified", 9_000_000)], "path string, change string, ms long").select("path", "change", F.timestamp_millis("ms").alias("ts"))
    later.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("path string, change string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    query = changes.session_batches(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    found = {(r.path, r.change) for r in changes.last_change(spark.table("sessions")).collect()}
    assert found == {("a.py", "modified"), ("a.py", "deleted")}


def test_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(source)
    seen = []
    stream = spark.readStream.schema("path string, change string, ts timestamp").parquet(source)
    query = changes.apply_batches(stream, lambda df, _: seen.append(df.count()), lambda _: seen.append(-1)).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert seen == [5]
