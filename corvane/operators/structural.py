"""Numbering in a total order, lineage rules and packet tiers of structural nodes; ranking and traversal are in `stages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Tiers of a packet in their order.
TIERS = ["primary-canonical", "required-dependency", "conflict-or-superseded", "follow-up"]


def number(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1, without one task for all: ranges are sorted apart, and each begins after those before it."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    fixed = cut(sorted_rows)
    begins = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    # as many rows as partitions
    running = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = begins.withColumn("__before", running - F.col("__n"))
    out = fixed.join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__row") - F.col("__first") + 1).cast("long")).drop("__part", "__row", "__n", "__first", "__before")


def missing_domains(covered: DataFrame, required: list[str]) -> DataFrame:
    """One row: required domains that no node has."""
    return covered.select(F.explode("domains").alias("d")).where(F.col("d").isin(required)).agg(F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set("d"))).alias("missing"))


def lineage_reciprocity(edges: DataFrame) -> DataFrame:
    """(rule, src, dst): supersedes without predecessor, and the reverse."""
    a, b = (edges.where(F.col("kind") == k).select("src", "dst").distinct() for k in ("supersedes", "predecessor"))
    return a.join(b, ["src", "dst"], "left_anti").select(F.lit("supersedes-without-predecessor").alias("rule"), "src", "dst").unionByName(b.join(a, ["src", "dst"], "left_anti").select(F.lit("predecessor-without-supersedes").alias("rule"), "src", "dst"))


def generated_from_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of kind generated-from whose target isn't a source node."""
    return edges.where("kind = 'generated-from'").join(nodes.where("role = 'source'").select(F.col("id").alias("dst")), "dst", "left_anti")


def packet_tier():
    """The tier of a structural node by authority and lifecycle."""
    return F.when((F.col("authority") == "canonical") & (F.col("lifecycle") == "current"), TIERS[0]).when(F.col("lifecycle") == "superseded", TIERS[2]).when(F.col("lifecycle") == "current", TIERS[1]).otherwise(TIERS[3])


def tier_counts(nodes: DataFrame) -> DataFrame:
    """(tier, n, bytes)."""
    return nodes.groupBy(packet_tier().alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
