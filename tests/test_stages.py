"""Stage ranking, receipts, traversal and structural parse on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import stages
from corvane.sources import structural_parse as sp

KINDS = ["dependency", "design"]


def brute_traversal(ids, edges, seed, kinds, depth, max_nodes, max_edges):
    """Edge by edge, over lists and a queue."""
    order = lambda e: (stages.EDGE_KINDS.index(e["kind"]), e["src"], e["dst"], e["locator"], e["id"])
    near = lambda at: sorted((e for e in edges if at in (e["src"], e["dst"]) and e["kind"] in kinds), key=order)
    other = lambda e, at: e["dst"] if e["src"] == at else e["src"]
    visited, paths, queue, inspected, skipped, terminal = [seed], {seed: []}, [(seed, 0)], 0, [], "complete"
    while queue:
        at, d = queue.pop(0)
        if d == depth:
            if any(e["certainty"] == "known" and other(e, at) in ids and other(e, at) not in paths for e in near(at)):
                terminal = "depth-limit"
                break
            continue
        for e in near(at):
            if inspected == max_edges:
                terminal = "edge-limit"
                break
            inspected += 1
            if e["certainty"] != "known" or other(e, at) not in ids:
                skipped.append((e["id"], e["certainty"], "non-known" if e["certainty"] != "known" else "missing-target"))
                continue
            if other(e, at) in paths:
                continue
            if len(visited) == max_nodes:
                terminal = "node-limit"
                break
            visited.append(other(e, at))
            paths[other(e, at)] = [*paths[at], e["id"]]
            queue.append((other(e, at), d + 1))
        if terminal != "complete":
            break
    return visited, paths, inspected, skipped, terminal


@pytest.mark.parametrize(("depth", "max_nodes", "max_edges"), [(1, 100, 1000), (3, 100, 1000), (9, 100, 1000), (5, 7, 1000), (5, 100, 11)])
def test_traversal_matches_brute_force(spark, depth, max_nodes, max_edges):
    rng = random.Random(depth + max_nodes)
    ids = [f"n{i}" for i in range(20)]
    edges = [{"id": f"e{i:02}", "kind": rng.choice([*KINDS, "ownership"]), "src": rng.choice(ids), "dst": rng.choice([*ids, "gone"]), "locator": rng.choice("ab"), "certainty": rng.choice(["known"] * 4 + ["dynamic"])} for i in range(40)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    frame = spark.createDataFrame([tuple(e.values()) for e in edges], "id string, kind string, src string, dst string, locator string, certainty string")
    got = stages.traverse(nodes, frame, "n0", KINDS, depth, max_nodes, max_edges)
    visited, paths, inspected, skipped, terminal = brute_traversal(set(ids), edges, "n0", KINDS, depth, max_nodes, max_edges)
    assert (got.visited, {k: [s["id"] for s in p] for k, p in got.paths.items()}, got.inspected, got.skipped, got.terminal) == (visited, paths, inspected, skipped, terminal)
    assert stages.traversal_faults(nodes, frame, got, "n0", KINDS, depth, max_nodes, max_edges) == []
    assert got.rows(spark).count() == len(visited)


def test_tampered_traversals_are_found(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("1", "design", "a", "b", "", "known"), ("2", "design", "b", "c", "", "known")], "id string, kind string, src string, dst string, locator string, certainty string")
    check = lambda r: stages.traversal_faults(nodes, edges, r, "a", ["design"], 4, 10, 10)
    good = lambda: stages.traverse(nodes, edges, "a", ["design"], 4, 10, 10)
    assert check(good()) == []
    bad = good()
    bad.paths["c"] = bad.paths["c"][1:]
    assert "path c" in check(bad)
    bad = good()
    bad.visited.append("c")
    assert {"visited-nodes", "bounds"} <= set(check(bad))
    bad = good()
    bad.paths["b"] = [{**bad.paths["b"][0], "id": "9"}]
    assert "edges" in check(bad)
    for args in (("x", ["design"], 4, 10, 10), ("a", [], 4, 10, 10), ("a", ["ownership"], 4, 10, 10), ("a", ["design", "design"], 4, 10, 10), ("a", ["design"], 0, 10, 10), ("a", ["design"], 4, 5000, 10)):
        with pytest.raises(stages.StageError):
            stages.traverse(nodes, edges, *args)


def test_requests_are_checked():
    for bad in (stages.StageRequest("a", "soon"), stages.StageRequest("a", "design", ("x", "x")), stages.StageRequest("a", "design", (), ("other",)), stages.StageRequest("a", "design", limit=0)):
        with pytest.raises(stages.StageError):
            bad.validate()


def test_provenance_and_time_of_headers(spark):
    rows = [('{"sources":[{"resource":"a"},{"resource":" "},"x",{"resource":3}],"timestamp":"t"}', "# Citations [1](z)"), ('{"generated":{"at":"g"},"timestamp":"t"}', "x # Citations\n[1](u) [2]( ) [3](v)"), ('{"timestamp":5}', "[1](u)"), ('{"sources":[]}', "# Citations [1](u)")]
    frame = spark.createDataFrame(rows, "j string, body string").select(F.parse_json("j").alias("v"), "body")
    found = frame.select(sp.content_time(F.col("v")).alias("t"), sp.provenance_resources(F.col("v"), F.col("body")).alias("r")).collect()
    assert [(r["t"], r["r"]) for r in found] == [("t", ["a"]), ("g", ["u", "v"]), (None, []), (None, [])]


def test_statuses_of_other_tools(spark):
    rows = spark.createDataFrame([("draft",), ("active",), ("stable",), ("deprecated",), ("else",)], "s string")
    assert [r[0] for r in rows.select(sp.mapped_status(F.col("s"))).collect()] == ["draft", "stable", "stable", "deprecated", None]
