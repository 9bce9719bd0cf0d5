"""Policies, profiles, boundary lines and payloads on small bundles."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import brief_units, incremental, rules, validation
from corvane.sources import corpus, policy

POLICY = """schema_version: 1
coverage: [canonical, legacy]
frontmatter:
  required: [type, owner]
  optional: [title, tags, okf_status, freshness, resource, public_boundary]
  preserved_canonical_keys: [old]
  canonical_docs_frontmatter_state: strict
document_coverage:
  roots: [docs, notes/]
  native_bundle: [docs/a.md, docs/b.md, docs/c.md]
  canonical_documents: [docs/k.md, docs/gone.md]
  legacy_documents: [docs/old.md]
  bridge_targets: [tools/x.py, docs/bridge.md]
  excluded_documents:
    docs/skip.md: not ours
source_links:
  require_prefix: "https://ok.example/"
tags:
  allowed: [x, y]
status:
  allowed: [live]
public_boundary:
  values: [public, internal]
  path_allowlist: [docs/pub]
"""


def docs_of(spark, pages):
    return spark.createDataFrame(list(pages.items()), "path string, text string")


def test_policies():
    found = policy.parse_policy(POLICY)
    assert found.classified == ["docs/a.md", "docs/b.md", "docs/c.md", "docs/gone.md", "docs/k.md", "docs/old.md"] and found.excluded == ["docs/skip.md"]
    assert found.fields() == ["freshness", "okf_status", "owner", "public_boundary", "resource", "tags", "title", "type"] and "old" in found.fields(True)
    for bad in (
        "schema_version: 2", "coverage: [canonical]", "schema_version: 1\nnope: 1", "schema_version: 1\nstatus: x", "schema_version: 1\nstatus:\n  allowed: x", "schema_version: 1\ntags:\n  other: [a]", "schema_version: 1\ncoverage: [some]",
        "schema_version: 1\nfrontmatter:\n  canonical_docs_frontmatter_state: soon", "schema_version: 1\ndocument_coverage:\n  roots: [../x]", "schema_version: 1\ndocument_coverage:\n  roots: [/x]", "schema_version: 1\ndocument_coverage:\n  native_bundle: [a, a]",
        "schema_version: 1\ndocument_coverage:\n  native_bundle: [a]\n  legacy_documents: [a]", "schema_version: 1\ndocument_coverage:\n  excluded_documents:\n    a.md: ''", "schema_version: 1\npublic_boundary:\n  exact_allowlist:\n    a.md: 1", "schema_version: 1\nschema_version: 1",
    ):
        with pytest.raises(policy.PolicyError):
            policy.parse_policy(bad)


GOOD = "---\ntype: t\nowner: o\ntitle: T\nokf_status: live\ntags: [x]\nfreshness: 2024-01-01\nresource: r\npublic_boundary: internal\n---\n"


def test_strict_profile_with_a_policy(spark):
    pages = {
        "docs/a.md": GOOD + "[b](b.md#part) [c](./sub/../c.md) ![i](../../i.png) [w](http://x) [u](/abs) [t](../../../up.md) [n](notes.md)\n",
        "docs/b.md": GOOD + "[a](a.md) docs/k.md:2 docs/k.md:99 docs/k.md:0 /etc/x.md:1 ../y.md:1 docs/z.md:3 docs/gone.md:1 tools/x.py:7 docs/bridge.md:1 docs/k.md: x\n",
        "docs/c.md": GOOD.replace("[x]", "[x, z, q]").replace("freshness: 2024-01-01", "freshness: Stale").replace("internal", "public") + "[b](b.md) STALE_CLAIM\n# Citations\n[1](https://bad.example/x) [2](https://ok.example/y)\n",
        "docs/k.md": GOOD.replace("owner: o", "old: 1\nodd: 2").replace("internal", "else") + "[a](a.md)\n",
        "docs/old.md": "---\nother: 1\n---\n",
        "docs/skip.md": "nothing",
        "docs/new.md": GOOD + "[a](a.md)",
        "docs/sub/index.md": "# H\n[a](b)\n",
        "else/z.md": "left alone",
        "notesx/z.md": "left alone too",
    }
    found = {(r["path"], r["code"], r["detail"]) for r in validation.strict_profile(docs_of(spark, pages), policy.parse_policy(POLICY)).collect()}
    old = {("docs/old.md", c, d) for c, d in [("missing-type", None), ("title", None), ("status", None), ("tag", None), ("freshness", None), ("authority", None), ("citation-source", None), ("relationship", None), ("public-boundary", None), ("fm-required", "type"), ("fm-required", "owner"), ("fm-disallowed", "other"), ("migration-strict-legacy", None)]}
    assert found == old | {
        ("docs/a.md", "native-link-absolute", "/abs"), ("docs/a.md", "native-link-traversal", "../../../up.md"), ("docs/a.md", "native-link-unconfigured", "notes.md"),
        ("docs/b.md", "citation-out-of-range", "docs/k.md:99"), ("docs/b.md", "citation-invalid-line", "docs/k.md:0"), ("docs/b.md", "citation-absolute", "/etc/x.md:1"), ("docs/b.md", "citation-absolute", "../y.md:1"), ("docs/b.md", "citation-unconfigured", "docs/z.md:3"), ("docs/b.md", "citation-missing", "docs/gone.md:1"),
        ("docs/b.md", "citation-missing", "docs/bridge.md:1"), ("docs/b.md", "citation-invalid-line", "docs/k.md:"),
        ("docs/c.md", "tag-value", "1"), ("docs/c.md", "tag-value", "2"), ("docs/c.md", "public-path-disallowed", None), ("docs/c.md", "source-link-prefix", None), ("docs/c.md", "stale-body", None), ("docs/c.md", "stale-frontmatter", None),
        ("docs/k.md", "fm-required", "owner"), ("docs/k.md", "fm-disallowed", "odd"), ("docs/k.md", "boundary-value", None), ("docs/gone.md", "doc-missing", None), ("docs/new.md", "doc-unclassified", None), ("docs/sub/index.md", "doc-unclassified", None),
    }


def test_native_orphans_and_baselines(spark):
    text = "schema_version: 1\nfrontmatter:\n  canonical_docs_frontmatter_state: {}\ndocument_coverage:\n  roots: []\n  native_bundle: [a.md, b.md, c.md]\n  canonical_documents: [k.md]\n  legacy_documents: [l.md]"
    pages = {"a.md": GOOD + "[b](b.md)", "b.md": GOOD + "[b](b.md)", "c.md": GOOD + "[x](k.md)", "k.md": "STALE_CLAIM", "l.md": "x", "m.md": "x"}
    codes = lambda state: {(r["path"], r["code"]) for r in validation.strict_profile(docs_of(spark, pages), policy.parse_policy(text.format(state))).collect()}
    own = {(p, "status") for p in ("a.md", "b.md", "c.md")} | {("c.md", "native-orphan")}
    assert codes("legacy_baseline") - {(p, "fm-disallowed") for p in pages} == own
    strict = codes("strict")
    assert ("k.md", "stale-body") in strict and ("k.md", "missing-frontmatter") in strict and ("l.md", "migration-strict-legacy") in strict and not any(p == "m.md" for p, _ in strict)


def test_portable_profiles(spark):
    pages = {"a.md": "---\ntype: note\nsources: x\n---\n", "b.md": "﻿ ---\ntype: ' '\n--- \nx", "index.md": "---\nokf_version: 2\n---\n# H\n- [a](a.md)\n", "x/index.md": "---\nokf_version: 2\n---\n# H\n- [a](a.md)\n", "log.md": "# Log\n## 2024-01-02\n- x\n## 2024-01-01\n- y\n", "c.md": "---\ntype: [a]\n---\n", "d.md": "---\nopen: 1\n", "e.md": None}
    docs = docs_of(spark, pages)
    base = {(r["path"], r["code"]) for r in validation.portable_profile(docs).collect()}
    assert base == {("b.md", "blank-type"), ("c.md", "non-string-type"), ("d.md", "malformed-frontmatter"), ("e.md", "missing-type")}
    more = {(r["path"], r["code"]) for r in validation.portable_profile(docs, families=True).collect()}
    assert more - base == {("a.md", "sources-not-sequence"), ("index.md", "okf-version-non-string")}
    found, outcomes = validation.validate(docs, "v9")
    assert {(r["profile"], r["status"], r["selected"]) for r in outcomes.collect()} == {("v0.1", "fail", False), ("v0.2", "fail", False), ("strict", "fail", False), ("selection", "fail", True)}
    assert found.where("code = 'unknown-profile'").count() == 1


def test_lifecycle_of_packets(spark):
    pages = {
        "p/a.md": "---\nstatus: active\nnext: [b.md, {x: 1}]\n---\n".replace("{x: 1}", "other") + "[c](sub/c.md#x) [web](http://x/b.md)", "p/b.md": "---\nstatus: superseded\n---\n", "p/sub/c.md": "---\nstatus: superseded\n---\n", "q/d.md": "---\nstatus: active\n---\n[only](only.md) [two](two.md)",
        "r/only.md": "---\nstatus: superseded\n---\n", "r/two.md": "---\nstatus: superseded\n---\n", "s/two.md": "---\nstatus: draft\n---\n", "h.md": "---\ntype: Chief Librarian\n---\n", "i.md": "---\nwork_class: x\nstatus: superseded\n---\n", "j.md": "---\nrole: x\nstatus: draft\n---\n[b](p/b.md)",
    }
    found = {(r["path"], r["code"], r["detail"]) for r in validation.lifecycle_findings(validation.split_documents(docs_of(spark, pages))).collect()}
    assert found == {("p/a.md", "superseded_prompt_reference", "p/b.md"), ("p/a.md", "superseded_prompt_reference", "p/sub/c.md"), ("q/d.md", "superseded_prompt_reference", "r/only.md"), ("h.md", "packet_missing_authority_field", None)}


LINES = [
    ("const password = 'hunter2';", True), ('{"password": "hunter2"}', True), ("token: abcdef123,", True), ("api_key = os.environ['API_KEY']", True), ("secret = vault.production.secret", True), ("'run with token = process.env.TOKEN_X'", True), ("password = <your-password>", False), ("token: example", False),
    ("const x = /token=abcdef/;", False), ("'use token = abcdefg here'", False), ("mytoken = abcdefgh", False), ("token == abcdefgh", False), ("secret = ${SECRET_VALUE}", False), ("password: xxxxxxxx", False), ("password = short", False), ("token", False),
]


def test_credentials_on_lines(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, x string").select("i", F.array_contains(rules.boundary_codes(F.col("x")), "credential_assignment").alias("hit")).collect()
    assert [(LINES[r["i"]][0], r["hit"]) for r in sorted(rows)] == LINES


def test_allowlisted_lines_pass(spark):
    docs = docs_of(spark, {"a.md": "x\nsee /home/ann/notes\nsee /home/bob/notes"})
    sha = hashlib.sha256(b"see /home/ann/notes").hexdigest()
    allowed = spark.createDataFrame([("a.md", "private_home_path", 2, sha), ("a.md", "private_home_path", 3, sha)], "path string, code string, line_no int, line_sha256 string")
    assert [(r["line_no"], r["code"]) for r in rules.boundary_findings(docs, allowed).collect()] == [(3, "private_home_path")]


def test_sub_words(spark):
    rows = [("IndexBuilder", "build", True), ("Install", "stall", False), ("v2build", "build", True), ("my_build", "build", True), ("rebuild", "build", False), ("éBuild", "build", False), ("buil", "buil", True)]
    for text, root, hit in rows:
        assert spark.range(1).select(tx.has_morph_subword(F.lit(text), root, 4)).first()[0] is hit, text
    assert spark.range(1).select(tx.has_morph_subword(F.lit("abc"), "abc", 4)).first()[0] is False


def test_units_meet_stems_and_facts(spark):
    pages = [("docs/a.md", "many IndexBuilders", None), ("docs/b.md", "x", {"title": ["The builder"], "status": ["built"]}), ("docs/c.md", "studies", None), ("docs/d.md", "rebuild", {"status": ["building"]}), ("docs/e.md", "none", None)]
    frame = spark.createDataFrame(pages, "path string, text string, facts map<string,array<string>>").withColumns({c: F.lit(0) for c in ("active", "canonical", "public_safe", "confidence")})
    got = {r["path"]: (r["structural"], r["detail"]) for r in brief_units.score(frame, "where is the builder study").collect()}
    assert got == {"docs/a.md": (2000, 10), "docs/b.md": (2000, 250), "docs/c.md": (1500, 10)}


def test_snapshot_digest_matches_brute_force(spark):
    rows = [(f"p{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(900)]
    parts = {}
    for path, sha in rows:
        parts.setdefault(zlib.crc32(path.encode()) % 256, []).append(f"{path}\0{sha}")
    whole = "\n".join(f"{k}:{hashlib.sha256(chr(10).join(sorted(v)).encode()).hexdigest()}" for k, v in sorted(parts.items()))
    row = incremental.snapshot_digest(spark.createDataFrame(rows, "path string, sha256 string")).first()
    assert (row["files"], row["digest"]) == (900, hashlib.sha256(whole.encode()).hexdigest())


def test_oversized_files_with_nul_bytes(tmp_path, spark):
    (tmp_path / "a.bin").write_bytes(b"\x10\x0aA\x00" + b"x" * 3000)
    (tmp_path / "b.md").write_bytes(b"\x10\x0a" + b"0" * 3000)
    found = {r["path"]: r["kind"] for r in corpus.scan_tree(spark, str(tmp_path), max_file_bytes=1000)[1].collect()}
    assert found == {"a.bin": "unsupported-input", "b.md": "oversized-input"}
    with pytest.raises(corpus.ScanLimit):
        corpus.scan_tree(spark, str(tmp_path), max_files=1)
    with pytest.raises(corpus.ScanLimit):
        corpus.scan_tree(spark, str(tmp_path), max_file_bytes=4000, max_total_bytes=4000)
    assert corpus.scan_tree(spark, str(tmp_path), max_file_bytes=4000, max_files=2, max_total_bytes=8000)[0].count() == 2


@pytest.mark.parametrize("name", ["validate_outcomes", "validate_strict", "validate_families"])
def test_texts_and_headers_are_read_once_for_all_rules(name, spark, sf):
    from corvane.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "EvalPython" not in plan and "documents.parquet" not in plan
