"""Ranking of structural nodes for a stage of work, its receipts, and bounded traversal with paths.

Nodes: id, path, owner (null without one), domains, lifecycle, authority, generated_status. Edges: id, kind, src, dst, locator, certainty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..session import cut
from .structural import number

# Enumerations in the order that sorting follows.
LIFECYCLES = ["current", "superseded", "draft", "archive", "rejected"]
AUTHORITIES = ["canonical", "approved", "supporting", "unknown"]
GENERATED = ["source", "generated", "preextracted"]
AUTHORITY_KEYS = ["canonical-owned", "approved-owned", "canonical-unowned", "approved-unowned", "supporting-owned", "supporting-unowned", "unknown-owned", "unknown-unowned"]
REVISION_KEYS = ["current", "predecessor", "superseded", "draft", "archive", "rejected"]
ARTIFACT_KEYS = ["source", "generated-or-preextracted", "archive", "rejected"]
DISTANCE_KEYS = ["seed", "direct", "absent"]
RELEVANCE_KEYS = ["none", "partial", "exact"]
EDGE_KINDS = ["ownership", "lifecycle", "supersedes", "predecessor", "dependency", "impact", "requirement", "design", "implementation", "validation", "domain", "architecture", "business-flow", "generated-from", "source-link"]
TRAVERSABLE = ["dependency", "impact", "requirement", "design", "implementation", "validation", "domain", "architecture", "business-flow"]
EVIDENCE_CLASSES = ["requirement", "design", "implementation", "validation", "architecture", "business-flow"]

# The kind of edge that is a stage's evidence.
STAGES = {
    "legacy-reconstruction": "architecture", "requirements-reconciliation": "requirement", "replacement-specification": "requirement", "design": "design", "register-driver-contract": "design", "implementation": "implementation", "validation-release": "validation",
}

MAX_CANDIDATES, MAX_DEPTH, MAX_NODES, MAX_EDGES = 4_096, 64, 4_096, 65_536


class StageError(ValueError):
    """A request that can't be ranked or traversed."""


@dataclass(frozen=True)
class StageRequest:
    """seed: an id or a path. limit: how many eligible nodes are selected."""

    seed: str
    stage: str
    required_domains: tuple[str, ...] = ()
    required_classes: tuple[str, ...] = ()
    limit: int = 48

    def validate(self) -> None:
        """Raises StageError for unknown stages and classes, and for values given twice."""
        if self.stage not in STAGES:
            raise StageError(f"unknown stage {self.stage}")
        if set(self.required_classes) - set(EVIDENCE_CLASSES):
            raise StageError("unknown evidence class")
        if len(set(self.required_domains)) < len(self.required_domains) or len(set(self.required_classes)) < len(self.required_classes) or self.limit < 1:
            raise StageError("a domain or class is doubled, or the limit isn't positive")


def evidence_class(kind: Column) -> Column:
    """The evidence class of an edge's kind, null for kinds that are no evidence."""
    return F.when(kind.isin(EVIDENCE_CLASSES), kind)


def authority_key() -> Column:
    """Authority with or without an owner."""
    return F.concat_ws("-", "authority", F.when(F.col("owner").isNotNull(), "owned").otherwise("unowned"))


def artifact_key() -> Column:
    """Archived and rejected nodes by their lifecycle, others by how they were made."""
    return F.when(F.col("lifecycle").isin("archive", "rejected"), F.col("lifecycle")).when(F.col("generated_status") == "source", "source").otherwise("generated-or-preextracted")


def relevance_key(seed: str) -> Column:
    """Whether the seed is a node's id, path, owner or domain, or is part of one."""
    owner, domains = F.coalesce("owner", F.lit("")), F.coalesce("domains", F.array().cast("array<string>"))
    exact = (F.col("id") == seed) | (F.col("path") == seed) | F.coalesce(F.col("owner") == seed, F.lit(False)) | F.exists(domains, lambda d: d == seed)
    part = lambda c: F.contains(c, F.lit(seed))
    partial = part(F.col("id")) | part(F.col("path")) | (F.col("owner").isNotNull() & part(owner)) | F.exists(domains, part)
    return F.when(exact, "exact").when(partial, "partial").otherwise("none")


def with_direct_kinds(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds kinds: of the known edges between a node and a seed; a seed has all its known edges' kinds."""
    known = edges.where("certainty = 'known'")
    marked = F.broadcast(seeds.select(F.col("id").alias("seed")))
    ends = known.join(marked, known["src"] == F.col("seed"), "left_semi").unionByName(known.join(marked, known["dst"] == F.col("seed"), "left_semi"))
    kinds = ends.select(F.explode(F.array("src", "dst")).alias("id"), "kind").groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return nodes.join(kinds, "id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def predecessor_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes with a known lineage edge to or from a current node."""
    lineage = edges.where(F.col("kind").isin("supersedes", "predecessor") & (F.col("certainty") == "known"))
    current = nodes.where("lifecycle = 'current'").select("id")
    ahead = lineage.join(current.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return ahead.unionByName(lineage.join(current.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()


def rank(nodes: DataFrame, edges: DataFrame, frequencies: DataFrame, request: StageRequest) -> DataFrame:
    """All nodes with position, the ten parts of the rank key, raw and capped frequency, and decision (selected, selection-limit or lifecycle-conflict).

    frequencies: id, raw (basis points). Order: eligibility, authority, revision, artifact, distance to the seed, relevance falling, contribution
    falling, capped frequency falling, path, id. Positions come from ranges of a sorted table.
    """
    request.validate()
    seeds = nodes.where((F.col("id") == request.seed) | (F.col("path") == request.seed)).select("id")
    rows = with_direct_kinds(nodes.select("id", "path", "owner", "domains", "lifecycle", "authority", "generated_status"), edges, seeds)
    before = predecessor_ids(nodes, edges).withColumn("before", F.lit(True))
    rows = rows.join(before, "id", "left").join(F.broadcast(seeds.withColumn("is_seed", F.lit(True))), "id", "left").join(frequencies.select("id", "raw"), "id", "left")
    texts = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    contribution = F.size(F.array_intersect(F.coalesce("domains", F.array().cast("array<string>")), texts(request.required_domains))) + F.size(F.array_intersect("kinds", texts(request.required_classes))) + F.array_contains("kinds", F.lit(STAGES[request.stage])).cast("int")
    raw = F.coalesce("raw", F.lit(0))
    keys = {
        "eligible": F.col("lifecycle") == "current", "authority_key": authority_key(), "revision_key": F.when((F.col("lifecycle") == "superseded") & F.col("before"), "predecessor").otherwise(F.col("lifecycle")), "artifact_key": artifact_key(),
        "distance_key": F.when(F.col("is_seed"), "seed").when(F.size("kinds") > 0, "direct").otherwise("absent"), "relevance_key": relevance_key(request.seed), "contribution": contribution, "frequency": F.least(raw, F.lit(M.FREQUENCY_CAP)), "capped": raw > M.FREQUENCY_CAP,
    }
    rows = rows.withColumns(keys)
    at = lambda column, names: M.ordinal(F.col(column), names)
    order = [F.desc("eligible"), F.asc(at("authority_key", AUTHORITY_KEYS)), F.asc(at("revision_key", REVISION_KEYS)), F.asc(at("artifact_key", ARTIFACT_KEYS)), F.asc(at("distance_key", DISTANCE_KEYS)), F.desc(at("relevance_key", RELEVANCE_KEYS)), F.desc("contribution"), F.desc("frequency"), F.asc("path"), F.asc("id")]
    numbered = number(rows.select("id", "path", "domains", "kinds", *keys), order, "position")
    # eligible nodes come first, so their count is their position
    decision = F.when(~F.col("eligible"), "lifecycle-conflict").when(F.col("position") <= request.limit, "selected").otherwise("selection-limit")
    return numbered.withColumn("decision", decision)


def missing_evidence(ranked: DataFrame, request: StageRequest) -> DataFrame:
    """One row: required domains and evidence classes that no selected node covers."""
    chosen = ranked.where("decision = 'selected'").agg(F.array_distinct(F.flatten(F.collect_list("domains"))).alias("d"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("k"))
    texts = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    return chosen.select(F.array_except(texts(request.required_domains), "d").alias("domains"), F.array_except(texts(request.required_classes), "k").alias("classes"))


def ranking_faults(nodes: DataFrame, ranked: DataFrame, request: StageRequest) -> DataFrame:
    """(id, fault) where a ranking's receipt doesn't fit its nodes: unknown, missing or doubled ids, eligibility or decision against the lifecycle, a path that differs."""
    own = nodes.select("id", F.col("path").alias("own_path"), F.col("lifecycle").alias("own"))
    both = ranked.groupBy("id").agg(F.count(F.lit(1)).alias("of"), F.first("path").alias("path"), F.first("eligible").alias("eligible"), F.first("decision").alias("decision")).join(own, "id", "full_outer")
    current = F.col("own") == "current"
    fault = (
        F.when(F.col("own").isNull(), "unknown-node").when(F.col("of").isNull(), "missing-candidate").when(F.col("of") > 1, "doubled-candidate").when(F.col("path") != F.col("own_path"), "path-differs").when(F.col("eligible") != current, "eligibility-differs")
        .when((F.col("decision") == "lifecycle-conflict") == current, "decision-differs")
    )
    found = both.select("id", fault.alias("fault")).where("fault is not null")
    taken = ranked.where("decision = 'selected'").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > request.limit).select(F.lit("").alias("id"), F.lit("selection-exceeds-limit").alias("fault"))
    return found.unionByName(taken)


# --- traversal ---------------------------------------------------------------------------------------------------------


@dataclass
class Receipt:
    """What a traversal visited, in order, with the steps to each node, the edges that it skipped, its counts and why it ended."""

    visited: list[str]
    paths: dict[str, list[dict]]
    inspected: int = 0
    accepted: int = 0
    skipped: list[tuple[str, str, str]] = field(default_factory=list)
    terminal: str = "complete"

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, position, depth, edges): the visited nodes with the ids of the edges that lead to each."""
        data = [(node, i, len(self.paths[node]), [s["id"] for s in self.paths[node]]) for i, node in enumerate(self.visited)]
        return spark.createDataFrame(data, "id string, position int, depth int, edges array<string>")


def traverse(nodes: DataFrame, edges: DataFrame, seed: str, kinds: list[str], max_depth: int = 4, max_nodes: int = 256, max_edges: int = MAX_EDGES) -> Receipt:
    """A search in both directions from a seed, edge by edge: of a node in the order kind, source, target, locator, id.

    Every level takes one job: the edges at its nodes, in their order, no more than the bound on inspected edges has left. A receipt holds
    max_nodes nodes and max_edges edges at most, so the fold over a level's edges is the driver's.
    """
    if not kinds or len(set(kinds)) < len(kinds) or set(kinds) - set(TRAVERSABLE):
        raise StageError("relationships are missing, doubled or not traversable")
    if not (1 <= max_depth <= MAX_DEPTH and 1 <= max_nodes <= MAX_NODES and 1 <= max_edges <= MAX_EDGES):
        raise StageError("a limit is out of range")
    if nodes.where(F.col("id") == seed).isEmpty():
        raise StageError(f"missing seed {seed}")
    spark = nodes.sparkSession
    allowed = edges.where(F.col("kind").isin(kinds))
    both = cut(allowed.select(F.col("src").alias("at"), "*").unionByName(allowed.where("src <> dst").select(F.col("dst").alias("at"), "*")))
    there = nodes.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    out, frontier = Receipt([seed], {seed: []}), [seed]
    for _ in range(max_depth):
        left = max_edges - out.inspected
        level = F.broadcast(spark.createDataFrame(list(enumerate(frontier)), "n int, at string"))
        near = both.join(level, "at").withColumn("next", F.when(F.col("src") == F.col("at"), F.col("dst")).otherwise(F.col("src")))
        order = ["n", M.ordinal(F.col("kind"), EDGE_KINDS), "src", "dst", "locator", "id"]
        rows = near.orderBy(*order).limit(left + 1)
        found = rows.join(there, "next", "left").orderBy(*order).select("at", "next", "id", "kind", "src", "dst", "locator", "certainty", "there").collect()
        frontier = []
        for e in found:
            if out.inspected == max_edges:
                out.terminal = "edge-limit"
                return out
            out.inspected += 1
            if e["certainty"] != "known" or not e["there"]:
                out.skipped.append((e["id"], e["certainty"], "non-known" if e["certainty"] != "known" else "missing-target"))
                continue
            if e["next"] in out.paths:
                continue
            if len(out.visited) == max_nodes:
                out.terminal = "node-limit"
                return out
            out.accepted += 1
            out.visited.append(e["next"])
            out.paths[e["next"]] = [*out.paths[e["at"]], {k: e[k] for k in ("id", "kind", "src", "dst", "locator")}]
            frontier.append(e["next"])
        if not frontier:
            return out
    seen = F.broadcast(spark.createDataFrame([(v,) for v in out.visited], "next string"))
    ends = F.broadcast(spark.createDataFrame([(v,) for v in frontier], "at string"))
    beyond = both.where("certainty = 'known'").join(ends, "at").withColumn("next", F.when(F.col("src") == F.col("at"), F.col("dst")).otherwise(F.col("src")))
    if not beyond.join(seen, "next", "left_anti").join(there, "next", "left_semi").isEmpty():
        out.terminal = "depth-limit"
    return out


def traversal_faults(nodes: DataFrame, edges: DataFrame, receipt: Receipt, seed: str, kinds: list[str], max_depth: int, max_nodes: int, max_edges: int) -> list[str]:
    """Why a receipt can't come from the graph: bounds, doubled or unknown nodes, paths that don't replay over known edges of allowed kinds."""
    spark = nodes.sparkSession
    faults = []
    if not receipt.visited or receipt.visited[0] != seed or len(set(receipt.visited)) < len(receipt.visited):
        faults.append("visited-nodes")
    if len(receipt.visited) > max_nodes or receipt.inspected > max_edges or receipt.accepted != len(receipt.visited) - 1 or set(receipt.paths) != set(receipt.visited) or any(len(p) > max_depth for p in receipt.paths.values()):
        faults.append("bounds")
    for node, steps in receipt.paths.items():
        at = seed
        for i, step in enumerate(steps):
            if at not in (step["src"], step["dst"]) or step["kind"] not in kinds:
                faults.append(f"path {node}")
                break
            at = step["dst"] if at == step["src"] else step["src"]
            if receipt.paths.get(at) != steps[: i + 1]:
                faults.append(f"path {node}")
                break
        else:
            if at != node:
                faults.append(f"path {node}")
    used = [(s["id"], s["kind"], s["src"], s["dst"], s["locator"]) for p in receipt.paths.values() for s in p[-1:]]
    named = spark.createDataFrame(used, "id string, kind string, src string, dst string, locator string")
    if not named.join(edges.where("certainty = 'known'").select("id", "kind", "src", "dst", "locator"), ["id", "kind", "src", "dst", "locator"], "left_anti").isEmpty():
        faults.append("edges")
    if not spark.createDataFrame([(v,) for v in receipt.visited], "id string").join(nodes.select("id"), "id", "left_anti").isEmpty():
        faults.append("nodes")
    return faults
