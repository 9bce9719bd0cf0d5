"""Benchmark decontamination: prefix-filtered join of word windows against whole texts, on built-in functions only.

A-Z becomes a-z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Each item gives windows of eight consecutive words, or one of all its words if
it has fewer. A window occurs where its words stand in a text in the same order without a gap. Words are ordered by their count in
the texts; since a window has to be contained whole, its prefix is one token, its rarest word. A text's words meet the windows of
that word only; the place of the word in the window fixes where the window would begin, places that don't fit into the text go
(length and positional bounds), and the slice of the text is compared with the window word by word before anything is shuffled.

The benchmark's windows are broadcast if their measured size is under a bound. Else a row of text, place and word for each word of each different
text meets the prefixes by a shuffle on the word, salted since a word may be frequent; what passes the bounds meets its text once more for the comparison.

Defined results: a null text has no words; nor has a null item. Repeated rows each keep their row, since hits are found per distinct
text. Null ids stay. Items with equal ids are one item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words as a class of what they hold, which Java matches about five times as fast as the class of what they don't.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
ANY_CASE_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"

#: Parts into which the rows of one text are dealt.
SALTS = 16


@dataclass(frozen=True)
class DecontaminateConfig:
    """words: window length. min_items: from so many items with an occurring window a text is contaminated.

    item_share: of one item's windows, for a leak; item_windows: the least number of them, so that a short phrase alone is no leak.
    """

    words: int = 8
    min_items: int = 2
    item_share: float = 0.5
    item_windows: int = 3


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z and nothing else; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_array(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, config: DecontaminateConfig, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window) of all items' windows, each once an item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), word_array(F.col(text).cast("string")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(config.words - 1), F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, config.words))).alias("window")).distinct()


def _measured(frame: DataFrame, *cols: str) -> int:
    """Bytes that the rows take about, measured."""
    return frame.agg(F.coalesce(F.sum(sum(F.octet_length(F.col(c).cast("string")) for c in cols) + 64), F.lit(0)).alias("n")).first()["n"]


def occurrences(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int | None = None) -> DataFrame:
    """(key, item, start, length, window): where windows of items occur; key is the MD5 of the text, start counts from 0.

    limit: bytes of windows that are broadcast, BROADCAST_BYTES unless given.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    wins = windows(benchmark, config, item_id, item_text)
    n_bytes = _measured(wins, "item", "window")
    texts = docs.select(F.md5(F.col(text).cast("string")).alias("key"), word_array(F.col(text).cast("string")).alias("w"))
    # rarity of the benchmark's words in the texts
    vocabulary = broadcast_if_small(wins.select(F.explode("window").alias("token")).distinct(), n_bytes, limit)
    counts = texts.select(F.explode("w").alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    placed = wins.select("window").distinct().select("window", F.posexplode("window").alias("offset", "token"))
    ranked = placed.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("first"))
    # a word that no text has leaves its window without an occurrence
    prefix = ranked.where("first.n > 0").select("window", F.col("first.token").alias("token"), F.col("first.offset").alias("offset"))
    if n_bytes <= limit:
        met = texts.select("key", "w", F.posexplode("w").alias("at", "token")).join(F.broadcast(prefix), "token")
        start, size = F.col("at") - F.col("offset"), F.size("window")
        fitting = met.where((start >= 0) & (start + size <= F.size("w"))).withColumn("start", start)
    else:
        different = texts.groupBy("key").agg(F.first("w").alias("w"))
        placed = different.select("key", F.size("w").alias("n"), F.posexplode("w").alias("at", "token")).withColumn("salt", F.pmod("at", F.lit(SALTS)))
        met = placed.join(prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
        start, size = F.col("at") - F.col("offset"), F.size("window")
        fitting = met.where((start >= 0) & (start + size <= F.col("n"))).select("key", start.alias("start"), "window").join(different, "key")
    found = fitting.where(F.slice("w", F.greatest("start", F.lit(0)) + 1, F.size("window")) == F.col("window"))
    found = found.select("key", "start", F.size("window").alias("length"), "window")
    return found.join(broadcast_if_small(wins, n_bytes, limit), "window").select("key", "item", "start", "length", "window")


def leaking_keys(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key): MD5 of texts that are contaminated, or that have at least `item_share` and `item_windows` of one item's windows."""
    found = occurrences(docs, benchmark, config, text, item_id, item_text)
    sizes = windows(benchmark, config, item_id, item_text).groupBy("item").agg(F.count(F.lit(1)).alias("windows"))
    per_item = found.groupBy("key", "item", "window").agg(F.lit(1).alias("one")).groupBy("key", "item").agg(F.count(F.lit(1)).alias("n"))
    per_item = per_item.join(broadcast_if_small(sizes, _measured(sizes, "item")), "item")
    per_key = per_item.groupBy("key").agg(F.count(F.lit(1)).alias("items"), F.max(F.when(F.col("n") >= config.item_windows, F.col("n") / F.col("windows"))).alias("share"))
    return per_key.where((F.col("items") >= config.min_items) | F.coalesce(F.col("share") >= config.item_share, F.lit(False))).select("key")


def report(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", **names) -> DataFrame:
    """The columns `keep` of every row of `docs` with n_words, n_hit, items (sorted ids as strings) and contaminated."""
    found = occurrences(docs, benchmark, config, text, **names)
    per_text = found.groupBy("key").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct("start", "length")).alias("spans"))
    # words inside any span: each span adds what lies beyond the furthest end before it
    step = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
    )
    per_text = per_text.select(F.col("key").alias("_key"), F.array_sort("items").alias("_items"), step["n"].cast("long").alias("_hit"))
    value = F.col(text).cast("string")
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.md5(value).alias("_key"), F.coalesce(F.regexp_count(value, F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    # one text may be a third of all rows: rows meet their text's hits by salted keys
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[f"k{i}" for i in range(len(keep))]), F.lit(SALTS)))
    per_text = per_text.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    out = rows.join(per_text, ["_key", "_salt"], "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"), (F.coalesce(F.size("_items"), F.lit(0)) >= config.min_items).alias("contaminated"),
    )
