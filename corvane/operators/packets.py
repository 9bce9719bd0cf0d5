"""Evidence packets within byte and token budgets: too-large items are skipped, smaller ones after them may still fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M


class PacketError(ValueError):
    """Required evidence doesn't fit, or evidence is missing or doubled."""


@dataclass(frozen=True)
class PacketLimits:
    """Bounds of a packet."""

    max_items: int = 48
    max_bytes: int = 64 * 1024
    max_tokens: int | None = 16 * 1024
    max_candidates: int = 4_096


def encoded() -> Column:
    """An item as the packet's payload has it."""
    return F.concat(F.lit("node="), "id", F.lit("\nsource="), "prov_source", F.lit("\nlocator="), "prov_locator", F.lit("\ncontent="), "content", F.lit("\n"))


def candidate_order() -> list[Column]:
    """Priority, authority and freshness falling, then id."""
    return [F.asc(M.ordinal(F.col("priority"), M.PRIORITIES)), F.desc("authority"), F.desc("freshness"), F.asc("id")]


def assemble(evidence: DataFrame, limits: PacketLimits = PacketLimits(), group: list[str] | None = None, by: list[Column] | None = None) -> DataFrame:
    """One row a group: selected ids, omitted ids, raw bytes, estimated tokens, truncated, failed (a required item that doesn't fit).

    evidence: id, prov_source, prov_locator, content, priority, authority, freshness; `by`: another total order. Each group's first max_candidates in order come into one
    array, a bound of the operator; a fold over it decides item by item, because what fits depends on all that was chosen before.
    """
    group = group or []
    order = Window.partitionBy(*group).orderBy(*(by or candidate_order()))
    rows = evidence.withColumns({"__n": F.row_number().over(order), "__bytes": F.octet_length(encoded()).cast("long")})
    listed = rows.where(F.col("__n") <= limits.max_candidates).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), "id", F.col("__bytes").alias("bytes"), "priority"))).alias("items"))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("selected"), none.alias("omitted"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("string").alias("failed"))

    def step(a: Column, x: Column) -> Column:
        total = a["bytes"] + x["bytes"]
        fits = (F.size(a["selected"]) < limits.max_items) & (total <= limits.max_bytes)
        if limits.max_tokens is not None:
            fits = fits & (F.ceil(total / 4) <= limits.max_tokens)
        taken = F.struct(F.concat(a["selected"], F.array(x["id"])).alias("selected"), a["omitted"].alias("omitted"), total.alias("bytes"), a["failed"].alias("failed"))
        failed = F.coalesce(a["failed"], F.when(x["priority"] == "required", x["id"]))
        left = F.struct(a["selected"].alias("selected"), F.concat(a["omitted"], F.array(x["id"])).alias("omitted"), a["bytes"].alias("bytes"), failed.alias("failed"))
        return F.when(fits, taken).otherwise(left)

    out = listed.select(*group, F.aggregate("items", zero, step).alias("p"))
    return out.select(*group, "p.selected", "p.omitted", F.col("p.bytes").alias("raw_bytes"), F.ceil(F.col("p.bytes") / 4).cast("long").alias("estimated_tokens"), (F.size("p.omitted") > 0).alias("truncated"), "p.failed")


def byte_metrics(candidates: DataFrame, selected: DataFrame, key: str = "path", size: str = "bytes") -> DataFrame:
    """One row: candidate, selected and avoided bytes, estimated tokens of the selected."""
    total = candidates.agg(F.coalesce(F.sum(size), F.lit(0)).alias("candidate_bytes"))
    chosen = candidates.join(selected.select(key).distinct(), key, "left_semi").agg(F.coalesce(F.sum(size), F.lit(0)).alias("selected_bytes"))
    both = total.crossJoin(F.broadcast(chosen))
    return both.select("candidate_bytes", "selected_bytes", F.greatest(F.col("candidate_bytes") - F.col("selected_bytes"), F.lit(0)).alias("avoided_bytes"), F.ceil(F.col("selected_bytes") / 4).cast("long").alias("estimated_tokens"))


def take_until(rows: DataFrame, order: list[Column], max_rows: int, max_bytes: int, size: Column) -> DataFrame:
    """Rows in order up to the first that exceeds a bound, with the running total and whether there were more; max_rows + 1 rows are read."""
    window = Window.orderBy(*order)
    best = rows.orderBy(*order).limit(max_rows + 1)
    marked = best.withColumns({"position": F.row_number().over(window), "__size": size.cast("long")})
    marked = marked.withColumn("total_bytes", F.sum("__size").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = (F.col("position") <= max_rows) & (F.col("total_bytes") <= max_bytes)
    return marked.withColumn("truncated", F.max(~fits).over(Window.partitionBy())).where(fits).drop("__size")


def freshness_key(freshness: Column) -> Column:
    """The first eight bytes of a freshness string as a whole number, big end first."""
    head = F.hex(F.substring(F.encode(freshness, "UTF-8"), 1, 8))
    return F.coalesce(F.conv(F.when(head != "", head), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


TIERS = ["primary-canonical", "required-dependency", "conflict-or-superseded", "follow-up"]


def assemble_tiers(evidence: DataFrame, limits: PacketLimits = PacketLimits(), group: list[str] | None = None) -> DataFrame:
    """A packet in the order of tiers (column tier, then position, then id); items of the first two tiers must fit, an id counts in its first tier only."""
    place = M.ordinal(F.col("tier"), TIERS)
    first = Window.partitionBy(*(group or []), "id").orderBy(place, "position")
    rows = evidence.withColumn("__k", F.row_number().over(first)).where(F.col("__k") == 1).drop("__k")
    rows = rows.withColumn("priority", F.when(place < 2, "required").otherwise("related"))
    return assemble(rows, limits, group, [F.asc(place), F.asc("position"), F.asc("id")])


def compression_outcome(payload: Column, compressed: Column, anchors: Column, max_bytes: int, codes: Column) -> Column:
    """Whether a compressed payload may stand for the payload: no data-loss code, every anchor kept, smaller, and within bounds; else the payload stays, with the reason."""
    lost = F.exists(anchors, lambda a: ~F.contains(compressed, a))
    return (
        F.when(compressed.isNull(), "unavailable").when(F.size(codes) > 0, "refused-data-loss").when(lost, "refused-anchor").when(F.octet_length(compressed) > max_bytes, "refused-size")
        .when(F.octet_length(compressed) >= F.octet_length(payload), "not-smaller").otherwise("admitted")
    )
