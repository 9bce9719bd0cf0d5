"""What a brief and a packet show of selected sources: excerpts, reasons, item texts, locators, and checks of the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .brief_units import PARENT_FACTS, RANKED_FACTS

# Sizes of an excerpt in bytes.
EXCERPT_BYTES, LEAD_BYTES, READ_BYTES = 900, 300, 256 * 1024
#: Pairs of metadata in an item's text, pairs of one key, relationships.
METADATA_PAIRS, PAIRS_OF_KEY, RELATIONSHIPS = 12, 2, 4

# Relationships that are a reason to select their target.
REASONS = {r: f"declared_{r}" for r in ("dependency", "implementation", "replacement", "supersedes", "validation", "reachability")}


def relationship_reason(relationship: Column) -> Column:
    """The reason that a relationship gives, null for those that give none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), relationship)


def excerpt(text: Column, terms: list[str]) -> Column:
    """Trimmed lines that aren't blank: the first ones to LEAD_BYTES, after them those with a term, cut at EXCERPT_BYTES between characters."""
    lines = F.filter(F.transform(F.split(tx.truncate_utf8(text, READ_BYTES), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    named = lambda x: F.lit(False)
    if terms:
        named = lambda x: tx.lower_ascii(x).rlike("|".join(f"\\Q{t}\\E" for t in terms))

    def step(out: Column, line: Column) -> Column:
        more = F.when(out == "", line).otherwise(F.concat(out, F.lit("\n"), line))
        return F.when(F.octet_length(out) >= EXCERPT_BYTES, out).when((F.octet_length(out) < LEAD_BYTES) | named(line), more).otherwise(out)

    return tx.truncate_utf8(F.aggregate(lines, F.lit(""), step), EXCERPT_BYTES)


def selected_sources(nodes: DataFrame, edges: DataFrame, selected: DataFrame, seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason) of selected nodes (id) that are files: seeds by their metadata, others by the first known relationship from a selected node that gives a reason."""
    chosen = nodes.join(selected.select("id").distinct(), "id", "left_semi").select("id", F.col("prov_locator").alias("path")).join(files.select("path"), "path", "left_semi")
    given = edges.where("certainty = 'known'").withColumn("reason", relationship_reason(F.col("relationship"))).where("reason is not null").join(selected.select(F.col("id").alias("src")), "src", "left_semi")
    first = given.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", F.col("id").alias("edge"), "reason")).alias("r"))
    marked = chosen.join(first, "id", "left").join(seeds.select("id").distinct().withColumn("seed", F.lit(True)), "id", "left")
    reason = F.when(F.col("seed"), "metadata_seed").otherwise(F.coalesce("r.reason", F.lit("declared_relationship")))
    return marked.groupBy("path").agg(F.max_by(reason, "id").alias("reason"))


def item_texts(nodes: DataFrame, edges: DataFrame, rankings: DataFrame, extras: DataFrame) -> DataFrame:
    """(id, text): what a packet says of each node.

    nodes: id, prov_locator, facts. rankings: id, rank, exact, partial, active, canonical, public_safe, confidence, freshness, reason. extras: id, digest, excerpt,
    symbols, each of which may be null. Nodes without a ranking are dependencies.
    """
    none = F.array().cast("array<string>")
    pairs = [F.transform(F.slice(F.coalesce(F.try_element_at("facts", F.lit(k)), none), 1, PAIRS_OF_KEY), _pair(k)) for k in RANKED_FACTS + PARENT_FACTS]
    metadata = F.array_join(F.slice(F.flatten(F.array(*pairs)), 1, METADATA_PAIRS), ";")
    known = edges.where("certainty = 'known'").withColumn("why", relationship_reason(F.col("relationship"))).where("why is not null")
    targets = known.join(nodes.select(F.col("id").alias("dst"), F.col("prov_locator").alias("at")), "dst").select(F.col("src").alias("id"), F.struct(F.col("id").alias("edge"), F.concat_ws("=", "why", "at").alias("line")).alias("l"))
    related = targets.groupBy("id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    rows = nodes.select("id", "prov_locator", metadata.alias("metadata")).join(related, "id", "left").join(rankings, "id", "left").join(extras, "id", "left")
    relationships = F.array_join(F.slice(F.transform(F.coalesce("l", F.array().cast("array<struct<edge:string,line:string>>")), lambda x: x["line"]), 1, RELATIONSHIPS), ";")
    tail = F.concat(F.coalesce(F.concat(F.lit("content-digest-sha256: "), "digest", F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("excerpt: "), "excerpt", F.lit("\n")), F.lit("")))
    middle = F.concat(F.lit("metadata: "), "metadata", F.lit("\nrelationships: "), relationships, F.lit("\n"))
    score = F.concat(*[x for k in ("exact", "partial", "active", "canonical", "public_safe", "confidence") for x in (F.lit(f"{k}="), F.col(k).cast("string"), F.lit(" "))], F.lit("freshness="), F.coalesce("freshness", F.lit("")))
    ranked = F.concat(F.lit("path: "), "prov_locator", F.lit("\nrank: "), F.col("rank").cast("string"), F.lit("\nscore: "), score, F.lit("\nmatch_reason: "), "reason", F.lit("\n"), middle, F.coalesce("symbols", F.lit("")), tail)
    plain = F.concat(F.lit("path: "), "prov_locator", F.lit("\nrank: dependency\n"), middle, tail)
    return rows.select("id", F.when(F.col("rank").isNotNull(), ranked).otherwise(plain).alias("text"))


def _pair(key: str):
    return lambda v: F.concat(F.lit(f"{key}="), v)


def term_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text holds, case of A-Z aside."""
    low = tx.lower_ascii(text)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in sorted(set(terms))), F.lit(0))


def native_locator(family: Column, name: Column, first: Column, second: Column, anchor: Column) -> Column:
    """Where an anchor stands, as readers cite it: Sheet!A1, page 2 block 3, section#4, slide 5 shape 6; the anchor's id where a part is missing or below 1.

    name: sheet or section; first and second: row and column, page and block, nothing and ordinal, slide and shape.
    """
    good = lambda *parts: F.coalesce(F.greatest(*[F.when(p >= 1, 0).otherwise(1) for p in parts], F.lit(0)) == 0, F.lit(False))
    named = F.coalesce(name != "", F.lit(False))
    return (
        F.when((family == "grid") & named & good(first, second), F.concat(name, F.lit("!"), tx.column_letters(second), first.cast("string")))
        .when((family == "fixed-layout") & good(first, second), F.concat(F.lit("page "), first.cast("string"), F.lit(" block "), second.cast("string")))
        .when((family == "flow") & named & good(second), F.concat(name, F.lit("#"), second.cast("string")))
        .when((family == "presentation") & good(first, second), F.concat(F.lit("slide "), first.cast("string"), F.lit(" shape "), second.cast("string")))
        .otherwise(anchor)
    )


def evidence_faults(selected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, fault) of packet evidence (id, priority, content, anchors) against the selected ids: doubled, missing, unrelated, required without an anchor, an anchor that its content lacks."""
    per_id = evidence.groupBy("id").agg(F.count(F.lit(1)).alias("of"), F.first("priority").alias("priority"), F.first("content").alias("content"), F.first("anchors").alias("anchors"))
    both = per_id.join(selected.select("id", F.lit(True).alias("chosen")).distinct(), "id", "full_outer")
    anchors = F.coalesce("anchors", F.array().cast("array<string>"))
    lost = F.exists(anchors, lambda a: ~F.contains(F.coalesce("content", F.lit("")), a))
    fault = (
        F.when(F.col("of") > 1, "doubled").when(F.col("of").isNull(), "missing").when(F.col("chosen").isNull(), "unrelated").when((F.col("priority") == "required") & (F.size(anchors) == 0), "required-without-anchor").when(lost, "anchor-not-in-content")
    )
    return both.select("id", fault.alias("fault")).where("fault is not null")


def bound_excerpts(excerpts: DataFrame, files: DataFrame, max_bytes: int = EXCERPT_BYTES) -> DataFrame:
    """(path, start, excerpt, fault): excerpts with the digest of their file; digest-mismatch, unknown-file, not-in-file, too-large or complete-file, null if all is well."""
    own = files.select("path", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    joined = excerpts.join(own, "path", "left")
    fault = (
        F.when(F.col("own").isNull(), "unknown-file").when(F.col("own") != F.col("sha256"), "digest-mismatch").when(F.octet_length("excerpt") > max_bytes, "too-large").when(F.col("excerpt") == F.col("text"), "complete-file")
        .when(F.substring("text", F.col("start") + 1, F.length("excerpt")) != F.col("excerpt"), "not-in-file")
    )
    return joined.select("path", "start", "excerpt", fault.alias("fault"))
