"""Near-duplicates: probability-MinHash signatures, banding, verification and connected classes.

Words are runs of letters and digits, A-Z lower-cased; a shingle is five consecutive words (a shorter text is one shingle); its weight
is one plus the natural logarithm of its count, so that repetition counts little. Each shingle sends a Poisson process of arrivals
whose rate is its weight; every arrival hits one of the signature's components, and the earliest shingle of a component is its value.
A shingle stops as soon as its next arrival is later than the latest component's best. Two texts agree in a component with the
probability Jaccard of their weighted shingles. Since the sets' Jaccard decides, which repetition doesn't change, each text has bands by
weights of one too; they are the same bands where no shingle is repeated.

Texts that share a band are linked only if the exact Jaccard of their shingle sets reaches the threshold. Candidates are stars, not all
pairs: in each bucket all are held against one centre, and bounds from what they share with it spare nearly all other pairs (see _moves).
So no pair of a bucket is lost, and none within a class is made again.

Defined results: equal texts (equal strings, empty ones too) are one class. Null texts are classes of their own, as are texts without a
word that have no equal. The class id is the least doc_id of the class. Rows with an equal doc_id are one document only if their texts are equal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.structural import number
from ..session import broadcast_if_small, cut, free_name, ship
from . import textbatch as tb

#: Texts with more than one in so many rows are joined by broadcast.
HOT_TEXTS = 1024

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MinHashConfig:
    """words: shingle length. bands x rows: components of a signature. centres: groups of a bucket's members from which further centres come at first."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 30
    rows: int = 7
    centres: int = 256


def shingles(data: np.ndarray, offs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, ordered by row and hash."""
    low = tb.lower_ascii(data)
    rows, starts, ends = tb.words(low, offs, tb.letter_or_digit_bytes())
    if not len(rows):
        return rows, np.zeros(0, np.uint64), rows
    hashes = tb.span_hashes(low, starts, ends)
    first = np.searchsorted(rows, np.arange(len(offs)))
    length = np.minimum(np.diff(first), n_words)  # words in a shingle of the row
    at = np.arange(len(rows))
    ok = at + length[rows] <= first[rows + 1]
    value = np.zeros(len(rows), np.uint64)
    for k in range(n_words):
        inside = ok & (k < length[rows])
        value[inside] = tb.mix(value[inside] * np.uint64(3) + hashes[at[inside] + k] + np.uint64(k))
    rows, value = rows[ok], value[ok]
    order = np.argsort(value)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]  # a chunk has fewer than 65,536 rows
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], value[at], np.diff(np.append(at, len(rows)))


def signatures(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """The ProbMinHash signature of each row (n_rows x size), zeros for rows without a shingle."""
    best = np.full(n_rows * size, np.inf)
    who = np.zeros(n_rows * size, np.uint64)
    arrival = np.zeros(len(rows))
    active = np.arange(len(rows))
    step = np.uint64(0)
    while len(active):
        step += np.uint64(1)
        draw = tb.mix(values[active] ^ np.uint64(int(step) * int(_GOLD) % (1 << 64)))
        arrival[active] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active]
        now = arrival[active]
        slot = rows[active] * size + (tb.mix(draw + _GOLD) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, slot, now)
        won = best[slot] == now
        who[slot[won]] = values[active][won]
        latest = best.reshape(n_rows, size).max(1)
        active = active[now < latest[rows[active]]]
    return who.reshape(n_rows, size)


def _band_keys(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n_rows: int, config: MinHashConfig) -> np.ndarray:
    """The key of each row's bands (n_rows x bands)."""
    who = signatures(rows, values, weights, n_rows, config.bands * config.rows).reshape(n_rows, config.bands, config.rows)
    key = np.zeros((n_rows, config.bands), np.uint64)
    for k in range(config.rows):
        key = tb.mix(key * np.uint64(5) + who[:, :, k])
    return tb.mix(key + np.arange(config.bands, dtype=np.uint64))


def _sketch(config: MinHashConfig):
    def run(batches):
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt")):
                rows, values, counts = shingles(data, offs, config.words)
                n = last - first
                plain = _band_keys(rows, values, np.ones(len(rows)), n, config)
                # the weights of texts without a repeated shingle are all one, so only the others have bands of their own by weight
                again = np.zeros(n, bool)
                again[rows[counts > 1]] = True
                weighted, some = plain.copy(), again[rows]
                if some.any():
                    place = np.cumsum(again) - 1
                    weighted[again] = _band_keys(place[rows[some]], values[some], 1 + np.log(counts[some]), int(again.sum()), config)
                empty = np.ones(n, bool)
                empty[rows] = False
                columns = [pa.array(plain[:, k].view(np.int64), mask=empty) for k in range(config.bands)]
                columns += [pa.array(weighted[:, k].view(np.int64), mask=weighted[:, k] == plain[:, k]) for k in range(config.bands)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[first:last], batch.column("digest")[first:last], *columns, pa.array(np.bincount(rows, minlength=n).astype(np.int32))], ["id", "digest", *(f"b{k}" for k in range(2 * config.bands)), "n"])

    return run


def _sets(config: MinHashConfig):
    def run(batches):
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt")):
                rows, values, _ = shingles(data, offs, config.words)
                at = np.searchsorted(rows, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id")[first:last], pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))], ["id", "grams"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and more) with common, the size of the meet of their shingle sets."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ga", "gb"))).drop("ga", "gb")


def _similar(common: Column, n: Column, m: Column, threshold: float) -> Column:
    """Whether sets of n and m with so many in common reach the Jaccard threshold."""
    return common >= F.lit(threshold) * (n + m - common) - F.lit(1e-9)


def components(edges: DataFrame) -> DataFrame | None:
    """(id, label): the least id that each end of an edge (a, b), a < b, is connected with; None without an edge.

    Every end moves to the least id around it, and on to where that one moves; edges move with their ends, and those within a class go.
    """
    total = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        onward = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = cut(step.join(onward, "to", "left").select("id", F.coalesce("far", "to").alias("to")))
        ends = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        edges = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if total is None:
            total = step.toDF("id", "label")
        else:
            total = cut(total.join(step.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
    return total


def classes(docs: DataFrame, config: MinHashConfig = MinHashConfig(), doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, class_id), one row for each row of `docs`; `digest`: the text's MD5 too."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("txt"))
    kind = base.schema["id"].dataType.simpleString()
    # rows without an id or a text never meet others
    alone = base.where("id is null or txt is null").select("id", F.col("id").alias("class_id"), F.md5("txt").alias("digest"))
    base = base.where("id is not null and txt is not null").withColumn("digest", F.md5("txt"))
    bands = [f"b{k}" for k in range(2 * config.bands)]
    sketch = base.mapInArrow(tb.tidy(_sketch(config)), f"id {kind}, digest string, " + ", ".join(f"{b} bigint" for b in bands) + ", n int")
    # one representative of equal texts; they have the same bands
    reps = cut(sketch.groupBy("digest").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("copies"), *(F.min(b).alias(b) for b in [*bands, "n"])))
    if reps.groupBy("own").agg(F.count(F.lit(1)).alias("of")).where("of > 1").isEmpty():
        reps, numbered = reps.withColumn("id", F.col("own")), False
    else:  # several texts under one id: numbers in the order of ids stand for them
        reps, numbered = cut(number(reps, [F.asc("own"), F.asc("digest")], "id")), True
    # texts whose sizes allow the threshold are in the same or in neighbouring classes of size, so each goes to two buckets a band
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(config.threshold))).cast("long")
    entries = reps.where("n > 0").select("id", "n", F.explode(F.array_compact(F.array(*bands))).alias("key"), size_class.alias("size"))
    entries = entries.select("id", "n", F.explode(F.array(F.xxhash64("key", "size"), F.xxhash64("key", F.col("size") + 1))).alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    members = cut(entries.join(crowded, "bucket"))
    crowds = members.groupBy("id").agg(F.sum("of").alias("crowd"))
    members = cut(members.drop("of").join(crowds, "id"))
    wanted = members.select("id").distinct().join(reps.select("id", "own", "digest"), "id")
    wanted = broadcast_if_small(wanted.select(F.col("id").alias("rep"), F.col("own").alias("id"), "digest"), members.count() * 64)
    sets = base.join(wanted, ["id", "digest"]).select(F.col("rep").alias("id"), "txt").mapInArrow(tb.tidy(_sets(config)), f"id {reps.schema['id'].dataType.simpleString()}, grams array<bigint>").groupBy("id").agg(F.first("grams").alias("grams"))
    rep_class = reps.select("digest", F.col("id").alias("label"))
    for moved in _moves(members, cut(sets), config):
        rep_class = rep_class.join(moved.toDF("label", "to"), "label", "left").select("digest", F.coalesce("to", "label").alias("label"))
    if numbered:
        rep_class = rep_class.join(reps.select(F.col("id").alias("label"), "own"), "label").select("digest", F.col("own").alias("label"))
    # texts with more than one in HOT_TEXTS of the rows, so HOT_TEXTS at most, meet their rows by broadcast; their rows are spread over the other join
    n_rows = reps.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = reps.where(F.col("copies") * HOT_TEXTS > n_rows).select("digest")
    hot = cut(rep_class.join(F.broadcast(hot), "digest", "left_semi").withColumnRenamed("label", "hot"))
    placed = base.select("id", "digest").join(F.broadcast(hot), "digest", "left")
    place = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string")))
    out = placed.withColumn("place", place).join(rep_class.withColumnRenamed("digest", "place"), "place", "left")
    out = out.select("id", F.coalesce("hot", "label").alias("class_id"), "digest").unionByName(alone)
    return out.select(F.col("id").alias(doc_id), "class_id", *["digest"] * digest)


def keep_one(docs: DataFrame, config: MinHashConfig = MinHashConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without all but one document of each class; repeated rows stay once. Rows without an id or a text stay."""
    key = F.md5(F.col(text).cast("string"))
    both = F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    repeated = docs.where(both).groupBy(doc_id, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        docs = docs.where(both).dropDuplicates([doc_id, text]).unionByName(docs.where(~both))
    found = classes(docs, config, doc_id, text, digest=True)
    # the class takes its id from one document; another text under that id is another document
    own_id, own_digest = free_name(docs.columns, "__id"), free_name(docs.columns, "__digest")
    gone = cut(found.where(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias(own_id), F.col("digest").alias(own_digest)).distinct())
    gone = broadcast_if_small(gone, gone.count() * 64)
    return docs.join(gone, (docs[doc_id] == F.col(own_id)) & (key == F.col(own_digest)), "left_anti")


def _moves(members: DataFrame, sets: DataFrame, config: MinHashConfig) -> list[DataFrame]:
    """Steps (id, label) of where labels go, in their order. members: (bucket, id, n, crowd) of buckets with two or more; crowd: how many
    members an id's buckets have together.

    First every member is held against the most crowded one of its bucket, the likeliest to be the text that others were made from. What is
    left are pairs x, y of a bucket in different classes. With i and e for how many of a text's shingles its centre has and hasn't:
    if x and y share no shingle beyond the centre's, they have min(ix, iy) in common at most, which is seldom enough, and the few pairs for
    which it is are compared. Else they share a shingle beyond the centre's; of those x needs only the first ex - (t * nx - ix) + 1 in any order
    that all keep, since so many must be common. Texts with the same such shingle and centre make a bucket of their own. The order of hashes
    finds the texts that meet another at all; among these the rarest shingles come first, so what many texts share is seldom needed, and a
    shingle's place px bounds what can follow it: a pair whose first common shingle it is has min(ix, iy) + min(ex - px, ey - py) in common at
    most. So no pair is lost.
    """
    t = config.threshold
    centres = members.groupBy("bucket").agg(F.min(F.struct(F.negative("crowd").alias("crowd"), "id", "n")).alias("c")).select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("nc"))
    placed = cut(members.join(centres, "bucket"))
    checked = cut(_compared(placed.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"), "n", "nc").distinct(), sets))
    moves: list[DataFrame] = []
    _link(checked.where(_similar(F.col("common"), F.col("n"), F.col("nc"), t)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), moves)
    held = placed.join(checked.select(F.col("a").alias("id"), F.col("b").alias("centre"), "common"), ["id", "centre"], "left")
    held = held.select("bucket", "id", "n", "crowd", "centre", F.coalesce("common", "n").alias("i"), F.lit(0).alias("more"), (F.col("id") == F.col("centre")).alias("done"), F.col("id").alias("label"))
    held = _several(_relabelled(held, moves))
    _rounds(_several(held.where(_able("i", "n", t))), sets, config, moves)
    held = _several(_relabelled(held.withColumn("label", F.col("id")), moves))
    apart = held.where("not done").select(F.col("id").alias("a"), F.col("centre").alias("b"), "n", "i", "crowd").distinct()
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    beyond = F.array_sort(F.array_except("ga", "gb"))
    needed = F.greatest(F.ceil(F.lit(t) * F.col("n") - F.lit(1e-9)) - F.col("i"), F.lit(1))
    first = F.slice(beyond, F.lit(1), F.greatest(F.size(beyond) - needed + 1, F.lit(0)).cast("int"))
    novel = apart.join(left, "a").join(right, "b").select(F.col("a").alias("id"), F.col("b").alias("centre"), "n", "i", "crowd", first.alias("g"))
    again = novel.select("id", "n", "i", "crowd", F.explode("g").alias("g"), "centre").withColumn("bucket", F.xxhash64("centre", "g"))
    shared = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("bucket")
    again = again.join(shared, "bucket").select("bucket", "id", "n", "i", "crowd", "centre", F.lit(False).alias("done"), F.col("id").alias("label"))
    live = cut(_several(_relabelled(again, moves)).select(F.col("id").alias("a"), F.col("centre").alias("b"), "n", "i", "crowd", "label").distinct())
    _rounds(_several(_rarest_first(live, left, right, t)), sets, config, moves)
    return moves


def _able(reach: Column | str, n: Column | str, threshold: float) -> Column:
    """Whether a set of n that can have so many in common with another can reach the Jaccard threshold with any."""
    reach, n = (F.col(x) if isinstance(x, str) else x for x in (reach, n))
    return reach >= F.lit(threshold) * n - F.lit(1e-9)


def _rarest_first(live: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Members of the buckets of shingles beyond the centre's, those in fewest texts of the centre first, as far as a text needs them.

    live: (a, b, n, i, crowd, label) of texts a and centres b. more: how many from the shingle on are beyond the centre's.
    """
    whole = live.join(left, "a").join(right, "b").select(F.col("a").alias("id"), F.col("b").alias("centre"), "n", "i", "crowd", "label", F.explode(F.array_except("ga", "gb")).alias("g"))
    whole = whole.select("id", "centre", "n", "i", "crowd", "label", F.xxhash64("centre", "g").alias("bucket"))
    often = whole.groupBy("bucket").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    # shingles of one text alone come before all others, so only their number matters
    ranked = whole.join(often, "bucket").groupBy("id", "centre", "n", "i", "crowd", "label").agg(F.sort_array(F.collect_list(F.struct("of", "bucket"))).alias("s"))
    placed = ranked.select("id", "n", "i", "crowd", "label", F.size("s").alias("many"), F.posexplode("s").alias("p", "s"))
    placed = placed.select("s.bucket", "id", "n", "crowd", "i", (F.col("many") - F.col("p")).alias("more"), F.lit(False).alias("done"), "label")
    return placed.where(_able(F.col("i") + F.col("more"), "n", threshold))


def _link(edges: DataFrame, moves: list[DataFrame]) -> None:
    moved = components(cut(edges))
    if moved is not None:
        moves.append(moved)


def _relabelled(members: DataFrame, moves: list[DataFrame]) -> DataFrame:
    """Members with their labels moved on."""
    for moved in moves:
        members = members.join(moved.toDF("label", "to"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    return members


def _several(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes and one or more that was no centre."""
    members = cut(members)
    mixed = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.when(~F.col("done"), 1)).alias("rest")).where("lo <> hi and rest > 0").select("bucket")
    return cut(members.join(mixed, "bucket", "left_semi"))


def _hopeful(members: DataFrame, threshold: float) -> DataFrame:
    """Members that some other class of their bucket may hold a similar text for, by its least size and its greatest bound.

    With i + more, a text has no more in common with another; so the threshold bounds the other's size (most). Work is linear in the members.
    """
    most = (F.col("i") + F.col("more")) * F.lit((1 + threshold) / threshold) - F.col("n") + F.lit(1e-6)
    sides = members.groupBy("bucket", "label").agg(F.min("n").alias("least"), F.max(most).alias("most"))
    ends = sides.groupBy("bucket").agg(F.min(F.struct("least", "label")).alias("lo"), F.max(F.struct("most", "label")).alias("hi"))
    # what the class of the extreme itself meets is the extreme of the others; null where there are none
    others = [F.min(F.when(F.col("label") != F.col("lo.label"), F.col("least"))).alias("least"), F.max(F.when(F.col("label") != F.col("hi.label"), F.col("most"))).alias("most")]
    ends = ends.join(sides.join(ends, "bucket").groupBy("bucket").agg(*others), "bucket")
    least = F.when(F.col("label") != F.col("lo.label"), F.col("lo.least")).otherwise(F.col("least"))
    greatest = F.when(F.col("label") != F.col("hi.label"), F.col("hi.most")).otherwise(F.col("most"))
    able = _able(F.col("i") + F.col("more"), "n", threshold) & (most >= least) & (F.col("n") <= greatest)
    return members.join(ends, "bucket").where(able).select(*members.columns)


def _rounds(held: DataFrame, sets: DataFrame, config: MinHashConfig, moves: list[DataFrame]) -> None:
    """Compares pairs of different classes in their buckets, until each bucket is one class or all its members were centres.

    A round's centres are the most crowded members of each of n groups by hash, n sixteen times more in each round. Only pairs count that can
    reach the threshold with i, what they share with the bucket's centre, and more, what else they may share.
    """
    t = config.threshold
    for n_round in range(1 << 30):
        held = cut(_hopeful(held, t))
        if held.isEmpty():
            return
        slot = F.pmod(F.xxhash64("id", F.lit(n_round)), F.lit(config.centres * 16**n_round))
        best = held.where(~F.col("done")).groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(F.negative("crowd").alias("crowd"), "id", "label", "n", "i", "more")).alias("c"))
        centres = cut(best.select("bucket", F.col("c.id").alias("other"), F.col("c.label").alias("lo"), F.col("c.n").alias("no"), F.col("c.i").alias("io"), F.col("c.more").alias("mo")))
        # a pair whose sizes differ too much can't reach the threshold; what was a centre before has met all members
        able = (F.least("n", "no") >= F.lit(t) * F.greatest("n", "no")) & (F.col("label") != F.col("lo"))
        able = able & _similar(F.least("i", "io") + F.least("more", "mo"), F.col("n"), F.col("no"), t)
        pairs = held.where(~F.col("done")).join(centres, "bucket").where(able)
        low = F.col("id") < F.col("other")
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "n", "no", F.when(low, F.col("label")).otherwise(F.col("lo")).alias("la"), F.when(low, F.col("lo")).otherwise(F.col("label")).alias("lb"))
        pairs = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("no").alias("no"), F.first("la").alias("la"), F.first("lb").alias("lb"))
        found = _compared(pairs, sets).where(_similar(F.col("common"), F.col("n"), F.col("no"), t))
        _link(found.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), moves)
        used = centres.select("bucket", F.col("other").alias("id"), F.lit(True).alias("used"))
        held = held.join(used, ["bucket", "id"], "left").withColumn("done", F.col("done") | F.col("used").isNotNull()).drop("used")
        held = _several(_relabelled(held, moves[-1:]))
