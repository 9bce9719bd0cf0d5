"""The brief ranking by units, for questions without an indexable word: coverage, place, rarity and detail of each unit, in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import corpus

# Weights of coverage, place and detail.
COVERAGE, ENTITY_COVERAGE, EXACT = 2_000, 3_000, 500
PLACES = {"filename_seg": 500, "filename_sub": 320, "path_seg": 350, "path_sub": 180, "stem_filename": 375, "stem_path": 262}
FACT_WORD, FACT_PART, PARENT_FACT = 250, 120, 30
BODY_WORD, BODY_HIT, BODY_CAP = 25, 10, 3

# Facts that count by their words, facts that count little, words that cover nothing beside others.
RANKED_FACTS = ["title", "tags", "tag", "alias", "aliases", "purpose", "responsibility", "symbol", "implements", "validates", "test", "tests", "keyword", "keywords"]
PARENT_FACTS = ["okf_status", "status", "public_boundary"]
STOP_WORDS = (
    "across after all also any are because been before being both can could did does each every had has have here how into its many may more most must often only onto "
    "other should some such than that their them then there these they those too unless until upon very was were what when where which who whom whose will would"
).split()


def rarity_weight(total: Column, df: Column) -> Column:
    """A whole-number logarithm of (total + 1) / (df + 1) with a linear fraction: 96 for each doubling, 8 at least."""
    numerator = total.cast("long") + 1
    ratio = F.floor(numerator * 65536 / F.least(df.cast("long") + 1, numerator)).cast("long")
    doublings = F.greatest(F.length(F.bin(ratio)) - 17, F.lit(0))
    fraction = F.shiftright(F.floor(ratio / F.pow(F.lit(2.0), doublings)).cast("long") - 65536, 10)
    return (8 + doublings * 96 + F.floor(fraction * 3 / 2)).cast("long")


def _fact_values(keys: list[str]) -> Column:
    """The values of a file's facts under some keys; `facts` is a map of lists."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(F.try_element_at("facts", F.lit(k)), none) for k in keys]))


def _unit_hit(unit: str, entity: bool, norm: str | None) -> Column:
    path, name, body = F.col("path"), tx.file_name(F.col("path")), F.coalesce("text", F.lit(""))
    low_path, low_name = tx.lower_ascii(path), tx.lower_ascii(name)
    in_path, in_name = F.contains(low_path, F.lit(unit)), F.contains(low_name, F.lit(unit))
    count = tx.occurrences_capped(tx.lower_ascii(body), unit, BODY_CAP)
    false = F.lit(False)
    holds = lambda v: F.contains(tx.lower_ascii(v), F.lit(unit))
    same = lambda v: tx.lower_ascii(v) == unit
    parent = F.exists("parent_facts", holds)
    if entity:
        flags = {"exact": false, "filename_seg": in_path & in_name, "filename_sub": false, "path_seg": in_path & ~in_name, "path_sub": false, "fact_word": F.exists("ranked_facts", holds), "fact_sub": false, "parent_fact": parent, "body_word": count > 0, "stem_filename": false, "stem_path": false, "stem_body": false}
    else:
        whole_path, seg = low_path == unit, tx.has_alnum_token(name, unit)
        inner = in_path & ~whole_path
        whole = tx.has_alnum_token(path, unit)
        root = (norm or "").removesuffix("y")
        stem_path = tx.has_morph_token(path, norm) | tx.has_morph_subword(path, root, 4) if norm else false
        flags = {
            "exact": whole_path | F.exists("ranked_facts", same), "filename_seg": inner & seg, "filename_sub": inner & ~seg & in_name, "path_seg": inner & ~seg & whole, "path_sub": inner & ~seg & ~in_name & ~whole,
            "fact_word": F.exists("ranked_facts", lambda v: ~same(v) & tx.has_alnum_token(v, unit)), "fact_sub": F.exists("ranked_facts", lambda v: ~same(v) & holds(v) & ~tx.has_alnum_token(v, unit)), "parent_fact": parent, "body_word": tx.has_alnum_token(body, unit),
            "stem_filename": stem_path & tx.has_morph_token(name, norm) if norm else false, "stem_path": stem_path, "stem_body": (count == 0) & (tx.has_morph_token(body, norm) | tx.has_morph_subword(body, root, 5)) if norm else false,
        }
    surface = F.greatest(*[flags[k] for k in ("exact", "filename_seg", "filename_sub", "path_seg", "path_sub", "fact_word", "fact_sub", "parent_fact")], count > 0)
    hit = F.struct(F.lit(unit).alias("unit"), F.lit(entity).alias("entity"), F.lit(not entity and unit in STOP_WORDS).alias("stop"), surface.alias("surface"), count.cast("long").alias("body_hits"), *[v.alias(k) for k, v in flags.items()])
    return F.when(surface | flags["stem_path"] | flags["stem_body"], hit)


def hits(files: DataFrame, question: str) -> DataFrame:
    """Files with the array of their unit hits; stop words are without effect where the question has other units."""
    row = files.sparkSession.range(1).select(tx.query_entities(F.lit(question)).alias("e"), tx.query_terms(F.lit(question)).alias("t")).select("e", "t", F.transform("t", tx.morph_norm).alias("n")).first()
    norms = {t: n for t, n in zip(row["t"], row["n"], strict=True) if t not in STOP_WORDS}
    found = [_unit_hit(u, True, None) for u in row["e"]] + [_unit_hit(u, False, norms.get(u)) for u in row["t"]]
    if not found:
        return files.where("false").withColumn("hits", F.lit(None))
    content = bool(row["e"]) or any(t not in STOP_WORDS for t in row["t"])
    if "facts" not in files.columns:
        files = files.withColumn("facts", F.lit(None).cast("map<string,array<string>>"))
    files = files.where(~corpus.excluded_from_brief(F.col("path"))).withColumns({"ranked_facts": _fact_values(RANKED_FACTS), "parent_facts": _fact_values(PARENT_FACTS)})
    return files.withColumns({"hits": F.array_compact(F.array(*found)), "content": F.lit(content)}).drop("ranked_facts", "parent_facts")


def score(files: DataFrame, question: str) -> DataFrame:
    """(path, structural, rarity, detail, tie) of files with a hit; document frequencies are counted over all files, one row broadcast."""
    from ..session import cut

    rows = cut(hits(files, question).select("path", "active", "canonical", "public_safe", "confidence", "hits", "content"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    df = rows.select(F.explode("hits").alias("h")).groupBy("h.unit").agg(F.count(F.lit(1)).alias("df"))
    # as many rows as the question has units
    weights = df.crossJoin(F.broadcast(total)).select("unit", rarity_weight(F.col("total"), F.col("df")).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("unit", "w"))).alias("weights"))
    ready = rows.where(F.size("hits") > 0).crossJoin(F.broadcast(weights))

    def structural(h: Column) -> Column:
        full = F.when(h["entity"], ENTITY_COVERAGE).otherwise(COVERAGE)
        place = F.greatest(*[F.when(h[k], w).otherwise(0) for k, w in PLACES.items()])
        return F.when(h["surface"], full).otherwise(F.floor(full * 3 / 4)) + F.when(h["exact"], EXACT).otherwise(0) + place

    def rarity(h: Column) -> Column:
        w = F.coalesce(F.try_element_at("weights", h["unit"]), F.lit(0))
        return F.when(h["surface"], w).otherwise(F.floor(w * 3 / 4))

    def detail(h: Column) -> Column:
        body = F.when((h["body_hits"] == 0) & h["stem_body"], BODY_HIT).otherwise(F.when(h["body_word"] & (h["body_hits"] > 0), BODY_WORD).otherwise(0) + h["body_hits"] * BODY_HIT)
        return body + F.when(h["fact_word"], FACT_WORD).when(h["fact_sub"], FACT_PART).otherwise(0) + F.when(h["parent_fact"], PARENT_FACT).otherwise(0)

    # stop words count only where there is nothing else
    counted = F.filter("hits", lambda h: ~(h["stop"] & F.col("content")))
    total_of = lambda f: F.aggregate(counted, F.lit(0).cast("long"), lambda a, h: a + f(h).cast("long"))
    tie = (F.col("active") * 100 + F.col("canonical") * 50 + F.col("public_safe") * 20 + F.col("confidence")).cast("long")
    return ready.select("path", total_of(structural).alias("structural"), total_of(rarity).alias("rarity"), total_of(detail).alias("detail"), tie.alias("tie"))


def rank(scored: DataFrame, top: int = 32) -> DataFrame:
    """The best files by the four numbers, then path."""
    return scored.orderBy(F.desc("structural"), F.desc("rarity"), F.desc("detail"), F.desc("tie"), F.asc("path")).limit(top)
