"""Headers by syntax and facts of lines, against plain line-by-line reading."""

import pytest

from corvane.sources import file_headers as fh

HEADERS = [
    ("a.md", "---\ntype: x\ntags: [a, 'b']\n---\nbody", {("type", "x"), ("tags", "a"), ("tags", "b")}, None), ("b.md", "\ufeff---\nk:\n  - one\n  - two\n---\n", {("k", "one"), ("k", "two")}, None), ("c.md", "---\nk: v\n", None, "open-header"), ("d.md", "x\n---\nk: v\n---\n", None, None),
    ("a.rs", "//! ---\n//! title: T\n//! ---\nfn x() {}", {("title", "T")}, None), ("b.rs", "// remark\n// ---\n// k: v\n// ---\n", {("k", "v")}, None), ("c.rs", "// ---\n// k: v\nfn x() {}", None, "open-header"), ("d.rs", "fn x() {}\n// ---\n// k: v\n// ---\n", None, None), ("e.rs", "// plain\n", None, None),
    ("a.py", "# ---\n# k: \"v w\"\n# ---\n", {("k", "v w")}, None), ("b.py", "#!/bin/x\n# ---\n# k: v\n# ---\n", {("k", "v")}, None), ("a.c", "/* ---\n * k: v\n * ---\n */\nint x;", {("k", "v")}, None), ("b.c", "/* ---\n * k: v\n */\n", None, "open-header"), ("c.c", "// ---\n// k: v\n// ---\n", {("k", "v")}, None), ("d.c", "/* plain */", None, None),
    ("a.bin", "---\nk: v\n---\n", None, None), ("x.md", "---\nk: {a}\n---\n", None, "no field"), ("y.md", "---\nk:\n---\n", None, "an empty value"), ("z.md", "---\n- a\n---\n", None, "an item without a key"), ("w.md", "---\nk: [a\n---\n", None, "an open list"), ("v.md", "---\nk: ''\n---\n", None, "empty scalar"), ("e.md", None, None, None),
]


def test_headers_by_syntax(spark):
    fields, errors = fh.declared(spark.createDataFrame([h[:2] for h in HEADERS], "path string, text string"))
    found = {}
    for r in fields.collect():
        found.setdefault(r["path"], set()).add((r["key"], r["value"]))
    assert found == {p: f for p, _, f, _ in HEADERS if f}
    assert {r["path"]: r["error"] for r in errors.collect()} == {p: e for p, _, _, e in HEADERS if e}


def test_very_long_headers(spark):
    rows = [("a.md", "---\n" + "k: v\n" * 20_000 + "---\n"), ("b.py", "# ---\n" + "# k: v\n" * 20_000 + "# ---\n"), ("c.c", "/* ---\n" + " * k: v\n" * 20_000 + " * ---\n */\n")]
    fields, errors = fh.declared(spark.createDataFrame(rows, "path string, text string"))
    assert fields.groupBy("path").count().count() == 3 and errors.count() == 0


def test_facts_of_lines(spark):
    rows = [
        ("s/a.rs", "use std::io;\n#[test]\npub fn checks_it() {}\n#[test]\n\nfn plain() {}\nstruct S;"), ("t/b.py", "import os, sys\nfrom a.b import c\ndef test_one(x):\n    pass\nclass K:\n"), ("j.js", "require('x/y')\nfunction go() {}"), ("m/Cargo.toml", "[package]\nname = \"n\"\n[dependencies]\nserde = \"1\"\n x-y = { a = 1 }\n[dev-dependencies]\nz = 1\n[other]\nq = 1"), ("n.toml", "[dependencies]\nserde = 1"),
    ]
    found = {(r["path"], r["key"], r["value"]) for r in fh.inferred(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {
        ("s/a.rs", "filename", "a.rs"), ("s/a.rs", "import", "std::io"), ("s/a.rs", "symbol", "checks_it"), ("s/a.rs", "test", "checks_it"), ("s/a.rs", "symbol", "plain"), ("s/a.rs", "symbol", "S"), ("t/b.py", "filename", "b.py"), ("t/b.py", "import", "os,"), ("t/b.py", "import", "a.b"), ("t/b.py", "symbol", "test_one"), ("t/b.py", "test", "one"),
        ("t/b.py", "symbol", "K"), ("j.js", "filename", "j.js"), ("j.js", "import", "x/y"), ("j.js", "symbol", "go"), ("m/Cargo.toml", "filename", "Cargo.toml"), ("m/Cargo.toml", "dependency", "serde"), ("m/Cargo.toml", "dependency", "x-y"), ("m/Cargo.toml", "dependency", "z"), ("n.toml", "filename", "n.toml"),
    }


@pytest.mark.parametrize("body", ["k v", "k: |", "- x", "k:\n- x", "k:\nm: v", "k: [a", "k: a]", "k: []", " : v"])
def test_fields_outside_the_subset(body):
    with pytest.raises(fh.FieldError):
        fh.flat_fields(body)
