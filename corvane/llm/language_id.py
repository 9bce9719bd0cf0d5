"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded number of different labelled texts of each language on the executors; the driver turns the summed counts into a
matrix of log-probabilities (languages x buckets), which is broadcast. Scoring adds its rows per text in numpy. Beyond BLOCK languages
the matrix travels in blocks, each in a pass of its own over the texts that carries on the best language so far.

Defined results: a null text, an empty one and one without a letter get `und` and score 0. Equal texts get equal results.
Of languages that are equally likely the first in the order of their names is taken. A text that stands under several languages trains each of them.
Rows keep their number, ids may be null or repeated, further columns don't matter. Without a labelled row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textbatch as tb

#: Languages whose log-probabilities travel together: 64 MB at 2 ** 15 buckets.
BLOCK = 512
#: Log-probabilities that are gathered at once.
GATHERED = 1 << 22


@dataclass(frozen=True)
class LanguageIdConfig:
    """orders: lengths of n-grams. buckets: a power of two. rows_per_language: the expected bound of different labelled texts of a language that train."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    alpha: float = 0.5
    rows_per_language: int = 2000


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray = field(repr=False)  # buckets x languages
    config: LanguageIdConfig = LanguageIdConfig()


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x20000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs
    return table


def ngrams(data: np.ndarray, offs: np.ndarray, config: LanguageIdConfig) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the (row, bucket) of its n-grams, none of which crosses rows or is blank; and each row's number of letters."""
    points, at = tb.code_points(data, offs)
    letters = letter_table()[points]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    is_letter = letters != 32
    out = []
    rolling = np.zeros(len(letters), np.uint64)
    seen = np.zeros(len(letters), bool)
    for n in range(1, max(config.orders) + 1):
        # a gram ends at each place; it grows by the character n - 1 before
        rolling[n - 1 :] = rolling[n - 1 :] * np.uint64(0x100000001B3) + letters[: len(letters) - n + 1]
        seen[n - 1 :] |= is_letter[: len(letters) - n + 1]
        if n in config.orders:
            ends = np.flatnonzero(seen[n - 1 :] & (rows[n - 1 :] == rows[: len(rows) - n + 1])) + n - 1
            buckets = (tb.mix(rolling[ends] + np.uint64(n)) & np.uint64(config.buckets - 1)).astype(np.int64)
            out.append((rows[ends], buckets))
    return out, tb.segment_sums(is_letter, at)


def train(docs: DataFrame, config: LanguageIdConfig = LanguageIdConfig(), text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from the rows of `docs` that have a text and a language; at most about rows_per_language different texts of each, picked by a hash of the text.

    Copies count once, so a text with many rows doesn't take the place of others. The prior is each language's share of all labelled rows.
    """
    spark = ship(docs.sparkSession)
    labelled = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    per_text = labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    totals = sorted(tuple(r) for r in per_text.groupBy("lang").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts")).collect())
    languages = [r[0] for r in totals]
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((config.buckets, 0), np.float32), config)
    shares = F.broadcast(spark.createDataFrame([(name, min(1.0, config.rows_per_language / texts)) for name, _, texts in totals], "lang string, share double"))
    picked = labelled.join(shares, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.col("share"))
    sample = picked.groupBy("lang", "text").agg(F.lit(1).alias("one")).select("lang", "text")
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            langs = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last, data, offs in tb.chunks(batch.column("text")):
                cells = np.concatenate([langs[first:last][rows] * config.buckets + grams for rows, grams in ngrams(data, offs, config)[0]])
                cells, more = np.unique(cells, return_counts=True)
                held, inverse = np.unique(np.concatenate([held, cells]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([n, more]), minlength=len(held)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held // config.buckets), pa.array(held % config.buckets), pa.array(n)], ["l", "b", "n"])

    sums = sample.mapInArrow(tb.tidy(count), "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), config.buckets))
    counts[sums["l"], sums["b"]] = sums["n"]
    log_prob = np.log(counts + config.alpha) - np.log(counts.sum(1, keepdims=True) + config.alpha * config.buckets)
    prior = np.array([rows for _, rows, _ in totals], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.ascontiguousarray(log_prob.T, np.float32), config)


def score_chunk(model: LanguageModel, data: np.ndarray, offs: np.ndarray, block: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row the best of a block of languages, its logarithm, the logarithm of the sum over the block, and the number of letters; model.log_prob holds the block alone."""
    grams, letters = ngrams(data, offs, model.config)
    total = np.tile(model.log_prior[block], (len(offs) - 1, 1))
    for rows, buckets in grams:
        at = np.searchsorted(rows, np.arange(len(offs)))
        # a few languages at a time, so that what is gathered stays small
        width = max(1, GATHERED // max(len(buckets), 1))
        for begin in range(0, total.shape[1], width):
            total[:, begin : begin + width] += tb.segment_sums(model.log_prob[:, begin : begin + width][buckets], at)
    best, top = total.argmax(1), total.max(1)
    return best, top, top + np.log(np.exp(total - top[:, None]).sum(1)), letters


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score, one row for each of `docs`."""
    ship(docs.sparkSession)
    # a text that is kept travels once
    source = f"k{keep.index(text)}" if text in keep else "txt"
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).cast("string").alias("txt")]))
    names = [f"k{i}" for i in range(len(keep))]
    passed = [c for c in frame.columns]
    state = ["best", "top", "total"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    n = len(model.languages)

    def pass_over(block: slice, first_pass: bool):
        part = LanguageModel(model.languages, model.log_prior, np.ascontiguousarray(model.log_prob[:, block]), model.config)
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches):
            m = shared.value
            for batch in batches:
                found = [[], [], []]
                for first, last, data, offs in tb.chunks(batch.column(source)):
                    best, top, total, letters = score_chunk(m, data, offs, block)
                    best = np.where(letters == 0, -1, best + block.start)
                    if not first_pass:
                        old = [batch.column(c)[first:last].to_numpy(zero_copy_only=False) for c in state]
                        better = top > old[1]  # of equal ones the first stays
                        best, top, total = np.where(better | (best < 0), best, old[0]), np.where(better, top, old[1]), np.logaddexp(total, old[2])
                    for held, values in zip(found, (best, top, total), strict=True):
                        held.append(values)
                cat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), cat(found[0], np.int64), cat(found[1], float), cat(found[2], float)], [*passed, *state])

        return tb.tidy(run)

    schema = f"{fields}, best long, top double, total double"
    if n:
        for begin in range(0, n, BLOCK):
            frame = frame.mapInArrow(pass_over(slice(begin, min(begin + BLOCK, n)), begin == 0), schema)
    else:
        frame = frame.withColumns({"best": F.lit(-1), "top": F.lit(0.0), "total": F.lit(0.0)})
    known = F.coalesce(F.col("best") >= 0, F.lit(False))
    labels = F.array(*map(F.lit, model.languages)) if n else F.array(F.lit("und"))
    label = F.when(known, F.get(labels, F.when(known, F.col("best")).otherwise(0).cast("int"))).otherwise("und")
    score = F.when(known, F.round(F.exp(F.col("top") - F.col("total")), 6)).otherwise(0.0)
    return frame.select(*names, label.alias("lang_pred"), score.alias("score")).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
