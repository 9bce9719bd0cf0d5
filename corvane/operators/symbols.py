"""Symbols with their occurrences in ranked documents, and budgets of document anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as tx


ROLES = ["definition", "implementation", "reference"]
#: Document matches that an answer shows.
MAX_MATCHES = 32


def candidates(question: Column) -> Column:
    """Distinct runs of the characters that a plain symbol name may hold, A-Z lower-cased, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}_+$-]+"), F.lit(0)), tx.lower_ascii)))


def evidence(symbols: DataFrame, occurrences: DataFrame, relations: DataFrame, ranked: DataFrame, names: list[str], limit: int = M.MAX_SYMBOL_EVIDENCE) -> DataFrame:
    """(position, rank, path, start_line, end_line, role, symbol, implements, truncated) of named symbols in ranked documents, the first by all that stands before.

    symbols: symbol, name, navigable. occurrences: path, symbol, definition, start_line, end_line. relations: symbol, target that it implements. A definition of
    a symbol that implements a named one is an implementation. truncated: there is more, beyond the limit or in documents without a rank.
    All named symbols and all pairs count, however many; their joins have no broadcast hint, so that Spark shuffles where they are large.
    """
    wanted = symbols.where(F.col("navigable") & tx.lower_ascii(F.col("name")).isin(names)).select("symbol").distinct()
    own = occurrences.join(wanted, "symbol", "left_semi").select("path", "symbol", "start_line", "end_line", F.when(F.col("definition"), ROLES[0]).otherwise(ROLES[2]).alias("role"), F.lit(None).cast("string").alias("implements"))
    pairs = relations.join(wanted.withColumnRenamed("symbol", "target"), "target", "left_semi").select("symbol", F.col("target").alias("implements")).distinct()
    more = occurrences.where("definition").join(pairs, "symbol").select("path", "symbol", "start_line", "end_line", F.lit(ROLES[1]).alias("role"), "implements")
    found = own.unionByName(more).distinct().join(ranked.select("path", "rank"), "path", "left")
    order = [F.asc("rank"), F.asc("path"), F.asc("start_line"), F.asc("end_line"), F.asc("role"), F.asc("symbol"), F.asc_nulls_first("implements")]
    # what has no rank is only counted; of the rest no more than limit + 1 rows are numbered
    unranked = F.broadcast(found.agg(F.count_if(F.col("rank").isNull()).alias("unranked")))
    first = found.where("rank is not null").orderBy(*order).limit(limit + 1).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    marked = first.withColumn("over", F.max(F.col("position") > limit).over(Window.partitionBy())).where(F.col("position") <= limit)
    return marked.crossJoin(unranked).select("position", "rank", "path", "start_line", "end_line", "role", "symbol", "implements", (F.col("over") | (F.col("unranked") > 0)).alias("truncated"))


def payload_lines(evidence_rows: DataFrame, qualified: DataFrame) -> DataFrame:
    """(path, line): the evidence of each document in its order; qualified: symbol with its qualified name."""
    name = qualified.select("symbol", "qualified")
    rows = evidence_rows.join(name, "symbol", "left").join(name.toDF("implements", "target"), "implements", "left")
    part = F.concat(F.concat_ws(" ", "role", F.coalesce("qualified", "symbol"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))), F.coalesce(F.concat(F.lit(" implements "), F.coalesce("target", "implements")), F.lit("")))
    listed = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))).alias("l"))
    return listed.select("path", F.concat(F.lit("scip_symbols: "), F.array_join(F.transform("l", lambda x: x["part"]), "; "), F.lit("\n")).alias("line"))


def freshness(recorded: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: stale if a recorded text differs from its scanned file, unverified if a document has no text or no file, else fresh."""
    both = recorded.select("path", F.col("text").alias("old")).join(scanned.select("path", F.col("text").alias("new"), F.lit(True).alias("there")), "path", "left")
    seen = F.col("there").isNotNull() & F.coalesce(F.col("old") != "", F.lit(False))
    totals = both.agg(F.count_if(seen & (F.col("old") != F.coalesce("new", F.lit("")))).alias("differ"), F.count_if(~seen).alias("unseen"))
    return totals.select(F.when(F.col("differ") > 0, "stale").when(F.col("unseen") > 0, "unverified").otherwise("fresh").alias("state"))


def anchor_budget(anchors: DataFrame, max_bytes: int = 8_192, max_anchors: int = 4_096) -> DataFrame:
    """Anchors that aren't blank nor too long, the first by id, with position."""
    kept = anchors.where(F.col("text").rlike(r"\S") & (F.octet_length("text") <= max_bytes))
    return kept.orderBy("id").limit(max_anchors).withColumn("position", F.row_number().over(Window.orderBy("id")).cast("long"))


def rank_matches(matches: DataFrame, limit: int = MAX_MATCHES) -> DataFrame:
    """Matches (bundle, path, id, score, derivation) with a score, in their order, `limit` at most: embedded ones ranked by score, derived ones after them without a rank."""
    own = F.col("derivation") == "embedded"
    order = [F.desc("own"), F.desc("by"), F.asc("bundle"), F.asc("path"), F.asc("id")]
    first = matches.where("score > 0").withColumns({"own": own, "by": F.when(own, F.col("score")).otherwise(0)}).orderBy(*order).limit(limit)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.select("position", "bundle", "path", "id", F.when(F.col("own"), F.col("position")).alias("rank"))


def autocomplete(candidates_: DataFrame, prefix: str) -> DataFrame:
    """The first three of the first ten candidates (ord, text) that begin so."""
    return candidates_.orderBy("ord").limit(10).where(F.startswith(F.lower("text"), F.lit(prefix.lower()))).orderBy("ord").limit(3)
