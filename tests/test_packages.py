"""Packages, imports, facades and findings of small trees in every language."""

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import audit
from quarrylens.sources import packages

TREES = {
    "python": {
        "app/core/__init__.py": "__all__ = ['run', \"stop\"]\ndef hidden(): pass\n", "app/core/a.py": "import os\nfrom ..util import x\nfrom . import b\n\ndef f(a):\n    from app.util import y\n", "app/__init__.py": "",
        "app/util/__init__.py": "def helper(a, b):\n    pass\ndef _own(): pass\n", "app/util/c.py": "import app.core.a\n", "loose.py": "import app.core\n",
    },
    "go": {
        "go.mod": "module example.org/shop\n\ngo 1.22\n", "main.go": 'package main\n\nimport (\n\t"fmt"\n\tst "example.org/shop/store/disk"\n)\n', "store/disk/d.go": "package disk\n\nfunc Open(path string) {}\nfunc (d *D) Close() {}\nfunc inner() {}\ntype Disk struct{}\n",
        "store/disk/d_test.go": 'package disk\n\nimport "example.org/shop"\n\nfunc TestOpen() {}\n',
    },
    "java": {
        "src/main/java/com/x/a/A.java": "package com.x.a;\n\nimport com.x.b.B;\nimport static com.x.b.C.z;\nimport java.util.List;\n\npublic class A {\n    public int get(int i) { return i; }\n    private void no() {}\n}\n",
        "src/main/java/com/x/b/B.java": "package com.x.b;\n\npublic final class B {\n}\n",
    },
    "rust": {"Cargo.toml": '[package]\nname = "my-box"\n', "src/lib.rs": "pub fn open(a: u8) {}\nfn own() {}\nuse crate::io::read;\n", "src/io/mod.rs": "pub struct Read;\nuse super::open;\nuse self::x;\nuse std::fs;\n"},
    "kotlin": {"A.kt": "package k.a\n\nimport k.b.Thing\n\nfun go(x: Int) {}\nprivate fun own() {}\n", "B.kt": "package k.b\n\ndata class Thing(val x: Int)\n"},
    "php": {"composer.json": "{}", "A.php": "<?php\nnamespace App\\Web;\nuse App\\Store\\Disk;\nfinal class A {}\n", "B.php": "<?php\nnamespace App\\Store;\nclass Disk {}\n"},
    "c_sharp": {"A.cs": "using App.Store;\nusing System;\nnamespace App.Web;\npublic class A {}\n", "B.cs": "namespace App.Store { public sealed class Disk {} }\n"},
    "scala": {"A.scala": "package s.a\n\nimport s.b.Thing\n\nobject A {\n  def f = {\n    import s.b.Other\n  }\n}\n", "B.scala": "package s.b\n\ncase class Thing(x: Int)\n"},
    "javascript": {
        "package.json": '{\n  "name": "web",\n  "version": "1"\n}\n', "src/a.js": "import x from './lib/b.js';\nimport y from 'lodash';\nexport function run(a) {}\n", "src/lib/b.js": "const z = require('../a');\nexport default class B {}\n", "src/lib/deep/c.ts": "import type { T } from '../../a';\nexport interface I {}\n",
    },
}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(f"{language}/{name}", text) for language, files in TREES.items() for name, text in files.items()]
    return spark.createDataFrame([*rows, ("python/none.py", None), (None, "x"), ("python/empty.py", ""), ("readme.md", "x")], "file string, content string")


def test_packages(tree):
    got = {r.file: r.package for r in packages.file_packages(tree).collect()}
    assert got == {
        "python/app/__init__.py": "app", "python/app/core/__init__.py": "app.core", "python/app/core/a.py": "app.core", "python/app/util/__init__.py": "app.util", "python/app/util/c.py": "app.util", "python/loose.py": None, "python/empty.py": None,
        "go/main.go": "example.org/shop", "go/store/disk/d.go": "example.org/shop/store/disk", "go/store/disk/d_test.go": "example.org/shop/store/disk", "java/src/main/java/com/x/a/A.java": "com.x.a", "java/src/main/java/com/x/b/B.java": "com.x.b",
        "rust/src/lib.rs": "my_box", "rust/src/io/mod.rs": "my_box::io", "kotlin/A.kt": "k.a", "kotlin/B.kt": "k.b", "php/A.php": "App\\Web", "php/B.php": "App\\Store", "c_sharp/A.cs": "App.Web", "c_sharp/B.cs": "App.Store", "scala/A.scala": "s.a", "scala/B.scala": "s.b",
        "javascript/src/a.js": "web", "javascript/src/lib/b.js": "web/lib", "javascript/src/lib/deep/c.ts": "web/lib/deep",
    }


def test_resolved_imports(tree):
    got = {(r.src, r.dst, r.inside) for r in packages.resolved_imports(tree).collect()}
    assert got == {
        ("app.core", "app.util", False), ("app.core", "app.util", True), ("app.util", "app.core", False), ("example.org/shop", "example.org/shop/store/disk", False), ("example.org/shop/store/disk", "example.org/shop", False), ("com.x.a", "com.x.b", False),
        ("my_box", "my_box::io", False), ("my_box::io", "my_box", False), ("k.a", "k.b", False), ("App\\Web", "App\\Store", False), ("App.Web", "App.Store", False), ("s.a", "s.b", False), ("s.a", "s.b", True),
        ("web", "web/lib", False), ("web/lib", "web", False), ("web/lib/deep", "web", False),
    }


def test_facades(tree):
    got = {r.package: (list(r.public_symbols), r.public_params) for r in packages.facades(tree).collect()}
    assert got["app.core"][0] == ["run", "stop"] and got["app.util"] == (["helper"], 2) and got["example.org/shop/store/disk"][0] == ["Close", "Disk", "Open"]
    assert got["com.x.a"][0] == ["A", "get"] and got["my_box"] == (["open"], 1) and got["k.a"][0] == ["go"] and got["App\\Web"][0] == ["A"] and got["App.Store"][0] == ["Disk"] and got["web/lib/deep"][0] == ["I"] and got["s.b"][0] == ["Thing"]


def test_findings_have_their_own_order(spark, tree):
    files = spark.createDataFrame([("a.py", 900, 1), ("b.py", 700, 1), ("c.py", 600, 20), ("d.py", 10, 50)], "file string, loc long, top_import_statements int")
    metrics = spark.createDataFrame([("p", 40, 100, 9, 1, 100.0), ("q", 1, 400, 0, 9, 44.4)], "package string, files long, loc long, fan_out long, interface long, ratio double")
    found = audit.findings(files, packages.resolved_imports(tree), metrics, 2).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.rule, []).append(r.subject)
    assert by["oversized_file"] == ["a.py", "b.py"] and by["kitchen_sink"] == ["p"] and by["shallow_package"] == ["q"] and by["function_imports"] == ["app.core", "s.a"]
    assert len(by["cycle"]) == 2 and "app.core,app.util" in by["cycle"]
    assert audit.findings(files, packages.resolved_imports(tree), metrics, None).where("rule = 'oversized_file'").count() == 3
    texts = {r.rule: r.value for r in audit.report(audit.findings(files, packages.resolved_imports(tree), metrics, 1)).collect()}
    assert texts["kitchen_sink"] == '{"rule":"kitchen_sink","findings":[{"rank":1,"subject":"p","size":100.0}]}'


def test_trees_of_nothing(spark, tree):
    empty = tree.limit(0)
    assert packages.file_packages(empty).count() == packages.resolved_imports(empty).count() == packages.facades(empty).count() == packages.dominant_language(empty).count() == 0
    assert packages.dominant_language(tree).first().language == "python"
    assert packages.layout_warning(tree.where(F.col("file").startswith("python/"))).first().asDict() == {"detected": 7, "walked": 5, "warning": False}
