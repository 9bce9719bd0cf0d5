"""The default ranking by exact and partial matches, and suppression of generic matches when an entity has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def order(cross_bundle: bool = False) -> list[Column]:
    """Exact, partial, active, canonical, public_safe, confidence and freshness falling, then bundle and path."""
    keys = [F.desc(c) for c in ("exact", "partial", "active", "canonical", "public_safe", "confidence", "freshness")]
    return [*keys, *([F.asc("bundle")] if cross_bundle else []), F.asc("path")]


def matches(files: DataFrame, question: str) -> DataFrame:
    """Files with any match: exact and partial counters and matched units. Values are path, file name, and the text's words for terms; entities may stand anywhere."""
    spark = files.sparkSession
    q = spark.range(1).select(tx.query_terms(F.lit(question)).alias("t"), tx.query_entities(F.lit(question)).alias("e")).first()
    low = {"__path": tx.lower_ascii(F.col("path")), "__text": tx.lower_ascii(F.coalesce("text", F.lit(""))), "__name": tx.lower_ascii(tx.base_name(F.col("path")))}
    within = lambda u: F.contains("__path", F.lit(u)) | F.contains("__text", F.lit(u))
    exact = [F.when((F.col("__path") == t) | (F.col("__name") == t), F.lit(t)) for t in q["t"]] + [F.when(within(e), F.lit(e)) for e in q["e"]]
    partial = [F.when(within(t), F.lit(t)) for t in q["t"]]
    found = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    # texts are folded once, and units pass through a generator, so that the filter doesn't look for them again
    rows = files.withColumns(low).select(*files.columns, F.explode(F.array(F.struct(found(exact).alias("exact_units"), found(partial).alias("partial_units")))).alias("__u"))
    rows = rows.select(*files.columns, "__u.exact_units", "__u.partial_units").withColumns({"exact": F.size("exact_units"), "partial": F.size("partial_units"), "entities_asked": F.lit(len(q["e"]))})
    return rows.where("exact > 0 or partial > 0")


def suppress_unanchored(matched: DataFrame, question: str) -> DataFrame:
    """Nothing, if an entity of the question matched nowhere and no file matches exactly."""
    spark = matched.sparkSession
    asked = spark.range(1).select(tx.query_entities(F.lit(question)).alias("asked"))
    state = matched.agg(F.coalesce(F.max("exact"), F.lit(0)).alias("most_exact"), F.array_distinct(F.flatten(F.collect_set("exact_units"))).alias("seen")).crossJoin(asked)
    state = state.select((F.size(F.array_except("asked", "seen")) > 0).alias("unmatched"), "most_exact")
    return matched.crossJoin(F.broadcast(state)).where(~(F.col("unmatched") & (F.col("most_exact") == 0))).drop("unmatched", "most_exact")


def rank(matched: DataFrame, limit: int = 32, cross_bundle: bool = False) -> DataFrame:
    """The best `limit` files with their rank."""
    best = matched.orderBy(*order(cross_bundle)).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order(cross_bundle))))


def term_coverage(files: DataFrame, question: str) -> DataFrame:
    """One row: matched and unmatched units, entities first, each sorted, and a warning list of eight."""
    spark = files.sparkSession
    found = matches(files, question).agg(F.array_distinct(F.flatten(F.collect_set(F.concat("exact_units", "partial_units")))).alias("seen"))
    row = spark.range(1).select(tx.query_entities(F.lit(question)).alias("e"), tx.query_terms(F.lit(question)).alias("t")).crossJoin(found)
    asked = F.concat("e", "t")
    rest = F.filter(asked, lambda x: ~F.array_contains("seen", x))
    return row.select(F.filter(asked, lambda x: F.array_contains("seen", x)).alias("matched"), rest.alias("unmatched"), F.slice(rest, 1, 8).alias("warned"), F.greatest(F.size(rest) - 8, F.lit(0)).alias("more"))
