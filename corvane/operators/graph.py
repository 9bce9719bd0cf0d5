"""Knowledge-graph queries over nodes and edges: integrity, lookup, neighbours, impact, reachability, trails, closures.

nodes(id, role, prov_source, prov_locator, confidence, facts MAP<STRING, ARRAY<STRING>>); edges(id, src, dst, relationship, certainty, confidence).
Searches go level by level: the frontier meets the edges by a join, nodes seen before leave by an anti join, and each level's
result is cut off into the shared checkpoint folder, so plans stay small and lost executors cost one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..session import cut, cut_counted
from .views import fact_values, has_fact


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id) of broken constraints: doubled ids, a missing source, a target that is there exactly if certainty isn't missing-target."""
    ids = nodes.select("id")
    doubled = lambda frame, rule: frame.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "id")
    no_source = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(F.lit("missing-source").alias("rule"), "id")
    marked = edges.join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("there")), "dst", "left")
    wrong = marked.where((F.col("certainty") == "missing-target") == F.col("there").isNotNull()).select(F.lit("target-certainty").alias("rule"), "id")
    return doubled(nodes, "duplicate-node").unionByName(doubled(edges, "duplicate-edge")).unionByName(no_source).unionByName(wrong)


def edge_certainty(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Adds certainty to (src, dst) rows: known if the target is among `known` paths, else missing-target."""
    return relations.join(known.select(F.col("path").alias("dst"), F.lit(True).alias("__there")).distinct(), "dst", "left").withColumn("certainty", F.when(F.col("__there").isNotNull(), "known").otherwise("missing-target")).drop("__there")


# --- lookup -----------------------------------------------------------------------------------------------------------

INDEXES = ["path", "title", "tag", "canonical"]


def _index_values(index: str) -> Column:
    if index == "path":
        return F.array("id", "prov_source", "prov_locator")
    keys = {"title": ["title"], "tag": ["tags", "tag"], "canonical": ["canonical", "authority", "resource", "status", "okf_status"]}[index]
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(fact_values(k), none) for k in keys])


def _traits() -> dict[str, Column]:
    active = has_fact("status", "active") | has_fact("okf_status", "active")
    canonical = has_fact("canonical", "true") | has_fact("canonical", "yes") | ((fact_values("authority").isNotNull() | fact_values("resource").isNotNull()) & active)
    fresh = F.coalesce(F.get(fact_values("timestamp"), F.lit(0)), F.get(fact_values("freshness"), F.lit(0)), F.lit(""))
    return {"active": active, "canonical": canonical, "freshness": fresh}


def lookup(nodes: DataFrame, needle: str, index: str | None = None) -> DataFrame:
    """(id, exact, index, value, active, canonical, confidence, freshness) of nodes with a value equal to the needle, or else containing it.

    Without an index the best of all four counts; of equal ones the last.
    """
    rows = nodes.withColumns(_traits())
    found = []
    for place, name in enumerate(INDEXES):
        if index in (None, name):
            values = _index_values(name)
            exact = F.array_contains(values, needle)
            part = F.get(F.filter(values, lambda v: F.contains(v, F.lit(needle))), F.lit(0))
            found.append(F.when(F.coalesce(exact, F.lit(False)), F.struct(F.lit(True).alias("exact"), F.lit(place).alias("place"), F.lit(needle).alias("value"))).when(part.isNotNull(), F.struct(F.lit(False).alias("exact"), F.lit(place).alias("place"), part.alias("value"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    rows = rows.withColumn("m", best).where("m is not null")
    return rows.select("id", "m.exact", F.get(F.array(*map(F.lit, INDEXES)), F.col("m.place")).alias("index"), "m.value", "active", "canonical", "confidence", "freshness")


def find_order() -> list[Column]:
    """Exact, active, canonical, confidence and freshness falling, then id."""
    return [*[F.desc(c) for c in ("exact", "active", "canonical", "confidence", "freshness")], F.asc("id")]


def bounded(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows with position and whether there are more; one row beyond the limit is read to know."""
    window = Window.orderBy(*order)
    best = rows.orderBy(*order).limit(limit + 1).withColumn("position", F.row_number().over(window))
    return best.withColumn("truncated", F.max(F.col("position") > limit).over(Window.partitionBy())).where(F.col("position") <= limit)


# --- one hop ----------------------------------------------------------------------------------------------------------


def neighbours(nodes: DataFrame, edges: DataFrame, start: str, backlinks_only: bool = False) -> DataFrame:
    """(id, edge_id, direction): nodes one hop away; both ways over known edges, or backward over any."""
    back = edges.where(F.col("dst") == start)
    if not backlinks_only:
        back = back.where("certainty = 'known'")
    back = back.select(F.col("src").alias("id"), F.col("id").alias("edge_id"), F.lit("backward").alias("direction"))
    if not backlinks_only:
        ahead = edges.where((F.col("src") == start) & (F.col("certainty") == "known")).select(F.col("dst").alias("id"), F.col("id").alias("edge_id"), F.lit("forward").alias("direction"))
        back = back.unionByName(ahead)
    return back.join(nodes.select("id"), "id", "left_semi")


def consumers(edges: DataFrame, target: str) -> DataFrame:
    """(edge_id, id, certainty): sources of edges to the target, whatever their certainty."""
    return edges.where(F.col("dst") == target).select(F.col("id").alias("edge_id"), F.col("src").alias("id"), "certainty")


# --- searches ---------------------------------------------------------------------------------------------------------


#: Rows of a level that are numbered in one window; larger ones are numbered by ranges of a sorted table.
WINDOW_ROWS = 1 << 16


def _numbered(level: DataFrame, order: list[str], n_rows: int, start: int) -> DataFrame:
    """A level with discovery numbers after `start`."""
    if n_rows > WINDOW_ROWS:
        from .structural import number

        return number(level, [F.asc(c) for c in order], "discovery").withColumn("discovery", F.col("discovery") + start)
    return level.withColumn("discovery", (F.row_number().over(Window.orderBy(*order)) + start).cast("long"))


def search(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None, backward: bool = False, carry: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(id, depth, parent, edge_id, discovery and `carry`) of what seeds (id and `carry`) reach over `edges`, and whether a bound stopped it.

    Of several edges to a node the one from the parent discovered first counts, then the least edge id. Discovery numbers are those of a queue.
    """
    carry = carry or []
    here, there = ("dst", "src") if backward else ("src", "dst")
    seen, n_seen = cut_counted(seeds.select("id", *carry).withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string"), "edge_id": F.lit(None).cast("string")}))
    seen = _numbered(seen, ["id"], n_seen, 0)
    frontier, n_seeds, stopped = seen, n_seen, False
    for depth in range(1, max_depth + 2):
        step = frontier.select(F.col("id").alias(here), F.col("discovery").alias("from_discovery"), *carry).join(edges.select("id", here, there), here)
        new = step.join(seen.select(F.col("id").alias(there)), there, "left_anti")
        if depth > max_depth:
            return seen, stopped or not new.isEmpty()
        # the least (parent's discovery, edge) of each new node; the aggregate is partial before its shuffle
        first = F.struct("from_discovery", "id", F.col(here).alias("parent"), *carry)
        new = new.groupBy(F.col(there).alias("node")).agg(F.min(first).alias("b"))
        new, n_new = cut_counted(new.select(F.col("node").alias("id"), *[F.col(f"b.{c}").alias(c) for c in carry], F.lit(depth).alias("depth"), F.col("b.parent").alias("parent"), F.col("b.id").alias("edge_id"), F.col("b.from_discovery").alias("from_discovery")))
        if not n_new:
            return seen, stopped
        new = _numbered(new, ["from_discovery", "edge_id", "id"], n_new, n_seen).drop("from_discovery")
        if max_nodes is not None and n_seen - n_seeds + n_new > max_nodes:
            new = new.where(F.col("discovery") <= n_seeds + max_nodes)
            return seen.unionByName(new), True
        seen, frontier, n_seen = seen.unionByName(new), new, n_seen + n_new
    return seen, stopped


#: Ids of a level that a join takes by broadcast; more meet the edges and what was seen by shuffle, or in the edges' own buckets.
BROADCAST_ROWS = 1 << 17


def _few(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int, backward: bool = False, among: DataFrame | None = None, until: str | None = None) -> tuple[list[tuple[DataFrame, int]], bool]:
    """The levels of a search, seeds first, as (table of ids, their number), and whether the depth stopped it. Only ids travel: for what needs no parents, edges or order.

    `among`: the only ids that may be met. `until` ends the search with the level that has it.
    """
    here, there = ("dst", "src") if backward else ("src", "dst")
    pairs = edges.select(here, there)
    found = [cut_counted(seeds.select("id").distinct())]
    for depth in range(1, max_depth + 2):
        frontier, n = found[-1]
        new = _few(frontier.withColumnRenamed("id", here), n).join(pairs, here).select(F.col(there).alias("id")).distinct()
        seen = found[0][0]
        for level, _ in found[1:]:
            seen = seen.unionByName(level)
        new = new.join(_few(seen, sum(k for _, k in found)), "id", "left_anti")
        if depth > max_depth:
            if among is not None:
                new = new.join(among.select("id"), "id", "left_semi")
            return found, not new.isEmpty()
        new, n_new = cut_counted(new)
        if among is not None and n_new:
            # few ids meet the others by broadcast, so that those needn't be shuffled
            kept = among.select("id").join(F.broadcast(new), "id").distinct() if n_new <= BROADCAST_ROWS else new.join(among.select("id"), "id", "left_semi")
            new, n_new = cut_counted(kept)
        if not n_new:
            return found, False
        found.append((new, n_new))
        if until is not None and not new.where(F.col("id") == until).isEmpty():
            return found, False
    return found, False


def _with_depth(found: list[tuple[DataFrame, int]], first: int = 0) -> DataFrame:
    """(id, depth) of the levels from `first` on."""
    out = found[0][0].where("false").withColumn("depth", F.lit(0))
    for depth, (level, _) in list(enumerate(found))[first:]:
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def impact(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int, max_results: int) -> DataFrame:
    """(id, depth, edge_id, position, truncated): what depends on the start over known edges, in the order of discovery."""
    known = edges.where("certainty = 'known'")
    found, stopped = search(known, nodes.where(F.col("id") == start).select("id"), max_depth, max_results, backward=True)
    return found.where("depth > 0").select("id", "depth", "edge_id", (F.col("discovery") - 1).alias("position"), F.lit(stopped).alias("truncated"))


def distances(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int, backward: bool = False) -> DataFrame:
    """(id, depth): the least number of edges from any seed, up to max_depth."""
    return _with_depth(levels(edges, seeds, max_depth, backward)[0])


def reachability(nodes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(id, outcome, reason, depth, truncated) of every node: one search from all entrypoints, one from the ends of uncertain edges."""
    known = edges.where("certainty = 'known'")
    near, cut_short = levels(known, nodes.where("role = 'entrypoint'").select("id"), max_depth)
    depth_of = _with_depth(near).withColumnRenamed("depth", "known_depth")
    doubtful = edges.where("certainty <> 'known'")
    ends = doubtful.select(F.col("src").alias("id")).unionByName(doubtful.select(F.col("dst").alias("id"))).join(nodes.select("id"), "id", "left_semi").distinct()
    doubted, taint_short = levels(edges, ends, max_depth)
    tainted = _with_depth(doubted).select("id", F.lit(True).alias("tainted"))
    # facts stay behind: a flag of them is all that the joins carry
    rows = nodes.select("id", "role", has_fact("coverage", "partial").alias("partial")).join(depth_of, "id", "left").join(tainted, "id", "left")
    bounded_search = F.lit(cut_short)
    partial = F.col("partial")
    cases = [
        (partial, "unknown", "partial-coverage"), (F.col("role") == "entrypoint", "active", "entrypoint"), (F.col("role") == "test", "test-only", "test-role"), (F.col("role") == "generated", "generated", "generated-role"),
        (F.col("known_depth").isNotNull(), "supporting", "known-path"), (bounded_search, "unknown", "depth-bound"), (F.col("tainted").isNotNull(), "unknown", "uncertain"), (F.lit(taint_short), "unknown", "depth-bound"),
    ]
    outcome, reason = F.lit("unreachable"), F.lit("no-known-path")
    for condition, o, r in reversed(cases):
        outcome, reason = F.when(condition, o).otherwise(outcome), F.when(condition, r).otherwise(reason)
    plain = ~partial & ~F.col("role").isin("entrypoint", "test", "generated") & F.col("known_depth").isNull()
    return rows.select("id", outcome.alias("outcome"), reason.alias("reason"), F.when(reason == "known-path", F.col("known_depth")).alias("depth"), (plain & F.lit(cut_short or taint_short)).alias("truncated"))


def zombies(classified: DataFrame) -> DataFrame:
    """Nodes proven unreachable."""
    return classified.where("outcome = 'unreachable' and not truncated").select("id", "reason")


def trail(nodes: DataFrame, edges: DataFrame, start: str, target: str, max_depth: int) -> DataFrame:
    """(position, id, edge_id): the shortest known path, of equal ones the one with least target and edge ids at each step; empty without one."""
    known = edges.where("certainty = 'known'")
    steps: list[tuple] = [] if nodes.where(F.col("id") == start).isEmpty() else [(1, start, None)]
    if steps and start != target:
        # back from the target to the level that has the start, then on by the least of the steps that come nearer, one row each
        back, _ = levels(known, nodes.sparkSession.createDataFrame([(target,)], "id string"), max_depth, backward=True, until=start)
        if back[-1][0].where(F.col("id") == start).isEmpty():
            back, steps = [], []
        for level, n in reversed(back[:-1]):
            ahead = known.where(F.col("src") == steps[-1][1]).join(_few(level.withColumnRenamed("id", "dst"), n), "dst", "left_semi")
            least = ahead.agg(F.min(F.struct("dst", "id")).alias("b")).select("b.*").first()
            steps.append((len(steps) + 1, least["dst"], least["id"]))
    return nodes.sparkSession.createDataFrame(steps, "position int, id string, edge_id string")


def dependency_closure(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, max_nodes: int | None = 256) -> tuple[DataFrame, bool]:
    """(id, depth) admitted beyond the seeds over known edges with a positive relationship, and whether a bound stopped it; all without max_nodes."""
    usable = edges.where((F.col("certainty") == "known") & F.col("relationship").isin(M.POSITIVE_RELATIONSHIPS))
    begin = seeds.join(nodes.select("id"), "id", "left_semi")
    if max_nodes is None:
        met, stopped = levels(usable, begin, max_depth, among=nodes)
        return _with_depth(met, 1), stopped
    found, stopped = search(usable.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), begin, max_depth, max_nodes)
    return found.where("depth > 0").select("id", "depth"), stopped


def strongly_cyclic(edges: DataFrame) -> DataFrame:
    """(id) of nodes on or between cycles: nodes without an edge in or out are peeled off until none is left to peel."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = cut(kept)
        now = left.count()
        if now == n:
            break
        n = now
    return left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()


def affected_nodes(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id): changed ids and their neighbours in the old and the new edges."""
    both = before.select("src", "dst").unionByName(after.select("src", "dst")).distinct()
    ahead = both.join(changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = both.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return changed.select("id").unionByName(ahead).unionByName(back).distinct()
