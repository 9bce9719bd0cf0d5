"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Tokens are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased, then one end token for each text. Words stand in a tree of classes, at most three levels of 16
each. The end and the 7 most frequent words are top classes of their own, the next 16 words stand right below one, the next 256 in the last level below another; all
other words share classes: they go by the last letters, then by sign, size and a letter before, then by a hash of the word. The model is
P(word | history) = P(top class | history) * P(class | top class, history) * P(last class | class, history) * P(word | last class).
Each of the first three factors is a softmax over 16 of summed weights, or one where a class has one word; a weight's row belongs to a hashed pair of a node of the tree and a feature: the
previous word, the previous two, the word before the previous one and the one before that (skips), and the classes of the last one and two
words; pairs count at the upper levels only. Its bias is the classes' share of all training tokens. The last factor is (c + 1) / sum of (c + 1) over the class, where each
shared class keeps a place of count 0 for unseen words. So it is a distribution over all training words, the end, and unseen words by class.

Counts cover every training token: executors count hashed words a partition at a time, one shuffle adds them up. Words with at least one
in `hot_bound` of all training tokens, at most that many, travel by broadcast; a text's other words meet their counts by a shuffle, salted since a word
that training hasn't seen may be frequent in other texts. Weights are trained by distributed gradient updates: all training texts are dealt by hash to
rounds and shards, and stand in a shard in the order of their hashes. In each round every shard makes Adagrad steps from the broadcast weights, and
the mean of the shards' changes of a row is added to it; changes are half-precision numbers, whose sum in double precision is exact. So the
weights depend neither on the order of rows nor on partitions. A text that makes up a great part of the rows is trained once with its number as weight.
Scoring works on sparse batches in numpy.

Defined results: a null or an empty text has one token, the end. Equal texts get equal scores. Rows keep their number; ids may be null or
repeated. Without a training text every word is unseen. Of equally frequent words those with the lower hash come first. Words are told apart by 64-bit
hashes, which among 100 million distinct words has two of one hash with probability 0.0003.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, ship
from . import textbatch as tb


@dataclass(frozen=True)
class MaxentConfig:
    """buckets: a power of two, rows of weights a feature. hot_bound: the most words whose counts are broadcast. flush: distinct words that a counting task holds.

    rounds: parts of all training texts, each dealt to shards of about `shard_tokens`, `max_shards` at most. rate: Adagrad's step. batch: tokens a step.
    """

    buckets: int = 1 << 16
    hot_bound: int = 1 << 21
    rounds: int = 3
    shard_tokens: int = 6_000_000
    max_shards: int = 1024
    rate: float = 0.4
    batch: int = 8192
    flush: int = 1 << 20


#: Classes below a node, and their number in three levels.
WIDE = 16
LEAVES = WIDE**3
NODES = 1 + WIDE + WIDE**2
#: Top classes that are the end or one word; then one with WIDE words below it, one with WIDE ** 2, and the shared ones.
DIRECT, BELOW, LAST, SHARED = 8, 8, 9, 10
#: Classes below this one hold one word each, and how many there are of them.
SINGLE = SHARED * WIDE**2
SINGLES = DIRECT + WIDE + WIDE**2


def single_classes() -> np.ndarray:
    """The last classes of the end and of the most frequent words in their order."""
    ranks = np.arange(SINGLES)
    return np.where(ranks < DIRECT, ranks * WIDE**2, np.where(ranks < DIRECT + WIDE, (BELOW * WIDE + ranks - DIRECT) * WIDE, LAST * WIDE**2 + ranks - DIRECT - WIDE))


@dataclass
class Vocabulary:
    """Counts over the training texts. hot: hashes, ordered, with counts. class_total: the sum of count + 1 of each last class."""

    total: int
    distinct: int
    hot: np.ndarray
    hot_count: np.ndarray
    top: np.ndarray  # hashes of the words that are classes of their own, ordered
    top_class: np.ndarray
    top_count: np.ndarray  # by class, 0 but for the end and the words that are classes of their own
    class_total: np.ndarray
    config: MaxentConfig = MaxentConfig()
    counts: DataFrame | None = field(default=None, repr=False, compare=False)


END = np.uint64(0xE7D)
FEATURES = 6


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, shared last class) of each word."""
    low = tb.lower_ascii(data)
    rows, starts, ends = tb.words(low, offs, tb.non_space_bytes())
    if not len(rows):
        return rows, np.zeros(0, np.uint64), rows
    hashes = tb.span_hashes(low, starts, ends)
    size = ends - starts
    mark = ~tb.letter_or_digit_bytes()[low[ends - 1]]  # ends with a sign
    back = np.where(mark & (size > 1), ends - 2, ends - 1)
    one, two, three = (low[np.maximum(back - k, starts)].astype(np.int64) for k in range(3))
    pairs, letters = _ending_tables()
    top = pairs[one * 256 + two]
    middle = mark * 8 + np.minimum(size // 3, 3) * 2 + letters[three]
    return rows, hashes, (((top << 4) + middle) << 4) + (tb.mix(hashes + np.uint64(99)) & np.uint64(WIDE - 1)).astype(np.int64)


@lru_cache(1)
def _ending_tables() -> tuple[np.ndarray, np.ndarray]:
    """The top class of each pair of last letters, and a bit for each letter before them."""
    one, two = np.repeat(np.arange(256, dtype=np.uint64), 256), np.tile(np.arange(256, dtype=np.uint64), 256)
    return (tb.mix(one * np.uint64(257) + two) % np.uint64(WIDE - SHARED)).astype(np.int64) + SHARED, (tb.mix(np.arange(256, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """The place in ordered hashes where each value of their upper bits begins, or the last place; about as many values as keys."""
    bits = len(keys).bit_length()
    counts = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(np.cumsum(counts) - counts, len(keys) - 1).astype(np.int32)


def _lookup(keys: np.ndarray, values: np.ndarray, hashes: np.ndarray, default: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The values of hashes in ordered keys; starts: of these keys, where they are kept."""
    if not len(keys):
        return np.full(len(hashes), default, np.int64)
    if starts is None:
        starts = _starts(keys)
    at = starts.take((hashes >> np.uint64(65 - len(starts).bit_length())).astype(np.int64))
    found = keys.take(at)
    behind = np.flatnonzero(found < hashes)
    while len(behind):  # upper bits of hashes are spread evenly, so few keys share a start
        at[behind] += 1
        behind = behind[at.take(behind) < len(keys)]
        found[behind] = keys.take(at.take(behind))
        behind = behind[found.take(behind) < hashes.take(behind)]
    return np.where(found == hashes, values.take(at, mode="clip"), default)


def with_ends(rows: np.ndarray, n_rows: int, *columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows' columns with one more entry at the end of each row."""
    counts = np.bincount(rows, minlength=n_rows)
    stop = np.cumsum(counts)
    all_rows = np.insert(rows, stop, np.arange(n_rows))
    return all_rows, [np.insert(c, stop, np.asarray(v, c.dtype)) for c, v in columns]


def contexts(rows: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The hashes of each token's features (FEATURES x tokens), from the words before it in its row."""
    n = len(rows)
    before = []
    kinds = []
    for k in (1, 2, 3):
        own = np.zeros(n, bool)
        own[k:] = rows[k:] == rows[:-k]
        h = np.full(n, k, np.uint64)
        h[k:][own[k:]] = hashes[:-k][own[k:]]
        c = np.full(n, LEAVES, np.uint64)
        c[k:][own[k:]] = classes[:-k][own[k:]].astype(np.uint64)
        before.append(h)
        kinds.append(np.where(c < SINGLE, c, c // np.uint64(WIDE)))  # shared classes without the hash of the word
    raw = [before[0], before[0] * np.uint64(31) + before[1], before[1] + np.uint64(7), before[2] + np.uint64(11), kinds[0] + np.uint64(13), kinds[0] * np.uint64(LEAVES) + kinds[1] + np.uint64(1 << 30)]
    out = np.empty((FEATURES, n), np.uint64)
    for i, x in enumerate(raw):  # they are mixed once more for each node
        own = out[i]
        np.multiply(x, np.uint64(0x9E3779B97F4A7C15 + 2 * i), out=own)
        own ^= own >> np.uint64(32)
    return out


#: The features that count at each level of the tree: pairs of words or classes tell little about the classes further down.
LEVEL_FEATURES = ((0, 1, 2, 3, 4, 5), (0, 2, 3, 4, 5), (0, 2, 3, 4))


def cells(features: np.ndarray, which: np.ndarray | slice, node: np.ndarray, level: int, buckets: int) -> np.ndarray:
    """The rows of weights of tokens' features at a node of a level (features of the level x tokens); no two features share a row."""
    own = LEVEL_FEATURES[level]
    out = np.empty((len(own), len(node)), np.int64)
    place = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row, k in zip(out, own, strict=True):
        x = features[k][which] + place
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - (buckets - 1).bit_length())
        row[:] = x
        row += k * buckets
    return out


def steps_down(classes: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
    """(which tokens, node, which of its classes) at each level; tokens of classes with one word go no further."""
    top = classes >> 8
    second, third = np.flatnonzero(top >= BELOW), np.flatnonzero(top >= LAST)
    below, last = classes[second], classes[third]
    return [(slice(None), np.zeros(len(classes), np.int64), top), (second, 1 + (below >> 8), below >> 4 & 15), (third, 1 + WIDE + (last >> 4), last & 15)]


def class_weights(weights: np.ndarray, bias: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of the summed weights of a node's classes for each token (tokens x WIDE), and their sums."""
    out, part = bias.take(node, axis=0), np.empty((len(node), WIDE), np.float32)
    for own in at:
        weights.take(own, axis=0, out=part, mode="clip")
        out += part
    np.clip(out, -60, 60, out=out)
    np.exp(out, out=out)
    # a row's numbers are always added up in the same order, wherever it stands, unlike in a matrix product
    return out, np.einsum("ij->i", out)


def log_chance(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray, buckets: int) -> np.ndarray:
    """The natural logarithm of each token's chance to be of its last class, given its features."""
    value = np.zeros(len(classes))
    for level, (which, node, y) in enumerate(steps_down(classes)):
        found, total = class_weights(weights, bias, cells(features, which, node, level, buckets), node)
        value[which] += np.log(found[np.arange(len(y)), y] / total)
    return value


def _counting(config: MaxentConfig):
    def run(batches):
        def merged(parts):
            hashes, which, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            out, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            return out, which[first], np.bincount(inverse, weights=n).astype(np.int64)

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])], ["h", "shared", "n"])

        held, parts, waiting = None, [], 0
        for batch in batches:
            for _, _, data, offs in tb.chunks(batch.column("txt")):
                rows, hashes, shared = tokens(data, offs)
                ends = len(offs) - 1
                part = merged([(np.append(hashes, END), np.append(shared, 0), np.append(np.ones(len(rows), np.int64), ends))])
                parts.append(part)
                waiting += len(part[0])
                if waiting > config.flush // 4:
                    held = merged(([held] if held else []) + parts)
                    parts, waiting = [], 0
                    if len(held[0]) > config.flush:
                        yield batch_of(held)
                        held = None
        if held or parts:
            yield batch_of(merged(([held] if held else []) + parts))

    return run


def count_words(texts: DataFrame, config: MaxentConfig) -> Vocabulary:
    """Counts all tokens of `texts` (column txt). The counts stay in a table of the shared folder; what the driver gets is bounded."""
    counts = cut(texts.mapInArrow(tb.tidy(_counting(config)), "h long, shared long, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("shared").alias("shared")))
    end = np.int64(END)
    all_of = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = all_of["n"], all_of["v"]
    top = counts.where(F.col("h") != int(end)).orderBy(F.desc("n"), "h").limit(SINGLES - 1).toPandas()
    # words that are classes of their own count as frequent, however few there are
    own = F.col("h").isin([int(end), *map(int, top["h"])])
    hot = counts.where((F.col("n") * config.hot_bound >= total) | own).toPandas()
    class_total = np.zeros(LEAVES)
    shared = counts.where(F.col("h") != int(end)).groupBy("shared").agg(F.sum(F.col("n") + 1).alias("n")).toPandas()
    class_total[shared["shared"].to_numpy(np.int64)] = shared["n"]
    class_total[SINGLE:] += 1  # the place of unseen words
    np.subtract.at(class_total, top["shared"].to_numpy(np.int64), top["n"].to_numpy(float) + 1)
    own_class = single_classes()[1 : 1 + len(top)]
    class_total[own_class] = top["n"].to_numpy(float) + 1
    ends = hot.loc[hot["h"] == int(end), "n"]
    class_total[0] = (int(ends.iloc[0]) if len(ends) else 0) + 1
    top_count = np.zeros(SINGLE, np.int64)
    top_count[own_class] = top["n"].to_numpy(np.int64)
    top_count[0] = class_total[0] - 1
    hashes = hot["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    top_hash = top["h"].to_numpy(np.int64).view(np.uint64)
    top_order = np.argsort(top_hash)
    return Vocabulary(int(total), int(distinct), hashes[order], hot["n"].to_numpy(np.int64)[order], top_hash[top_order], own_class[top_order], top_count, class_total, config, counts)


def prepared(data: np.ndarray, offs: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, last class) of each token with the ends."""
    rows, hashes, shared = tokens(data, offs)
    classes = _lookup(words.top, words.top_class, hashes, -1)
    classes = np.where(classes < 0, shared, classes)
    rows, (hashes, classes) = with_ends(rows, len(offs) - 1, (hashes, END), (classes, 0))
    return rows, hashes, classes


def _bias(words: Vocabulary) -> np.ndarray:
    """The logarithm of each class's share of its node (nodes x WIDE)."""
    total = words.class_total.copy()
    words_at = np.concatenate([single_classes(), np.arange(SINGLE, LEAVES)])
    total[words_at] = np.maximum(total[words_at], 0.5)
    total = np.maximum(total, 1e-9).reshape(WIDE, WIDE, WIDE)
    nodes = np.concatenate([total.sum((1, 2))[None], total.sum(2), total.reshape(-1, WIDE)])
    return np.log(nodes / nodes.sum(1, keepdims=True)).astype(np.float32)


def _summed(at: np.ndarray, slope: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of weights, sum of the slopes of the tokens that have each): at is FEATURES x tokens, slope tokens x WIDE, room an array for the sums."""
    shift = max((at.shape[1] - 1).bit_length(), 1)
    keys = at << shift
    keys |= np.arange(at.shape[1])
    keys = keys.ravel()
    if int(keys.max()) < 1 << 32:  # half the bytes to sort
        keys = keys.astype(np.uint32)
    keys.sort()
    own = keys >> shift
    token = (keys & ((1 << shift) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n = np.diff(np.append(first, len(own)))
    # rows of many tokens go first, so those with one more are always the first ones
    several = np.flatnonzero(n > 1)
    several = several[np.argsort(-n.take(several), kind="stable")]
    left = n.take(several)
    first = np.concatenate([first.take(several), first[n == 1]])
    if room is None:
        room = np.empty((at.size, WIDE), slope.dtype)
    gradient, done, live = slope.take(token.take(first), axis=0, out=room[: len(first)], mode="clip"), 1, len(several)
    while live > 64 and done < 12:  # most rows have few tokens: one of each at a time
        gradient[:live] += slope.take(token.take(first[:live] + done), axis=0)
        done += 1
        live = int(np.searchsorted(-left, -done))
    if live:
        rest = left[:live] - done
        begin = np.cumsum(rest) - rest
        places = np.arange(rest.sum()) + np.repeat(first[:live] + done - begin, rest)
        gradient[:live] += np.add.reduceat(slope.take(token.take(places), axis=0), begin, axis=0)
    return own.take(first).astype(np.int64), gradient


def sgd(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, features: np.ndarray, classes: np.ndarray, times: np.ndarray, config: MaxentConfig, used: np.ndarray, room: np.ndarray) -> None:
    """One Adagrad step over a batch of tokens; squares has one sum a row of weights, used marks the rows; room (2 x FEATURES * tokens x WIDE) is kept from step to step, since workers get memory for large arrays from the system each time."""
    weighted = bool((times != 1).any())
    whole = weights.view(f"V{weights.itemsize * WIDE}")[:, 0]  # a row as one item is written at once
    for level, (which, node, y) in enumerate(steps_down(classes)):
        if not len(y):
            continue
        at = cells(features, which, node, level, config.buckets)
        slope, total = class_weights(weights, bias, at, node)
        slope *= (1 / total)[:, None]
        slope.ravel()[np.arange(0, slope.size, WIDE) + y] -= 1
        if weighted:
            slope *= times[which, None]
        rows, gradient = _summed(at, slope, room[0])
        grown = squares.take(rows) + np.einsum("ij,ij->i", gradient, gradient)
        squares[rows] = grown
        gradient *= (np.float32(config.rate) / np.sqrt(grown))[:, None]
        held = weights.take(rows, axis=0, out=room[1, : len(rows)], mode="clip")
        held -= gradient
        whole[rows] = held.view(whole.dtype)[:, 0]
        used[rows] = True


#: Rows of weights whose changes travel together.
BLOCK = 8192


class _Shard:
    """The steps of one shard from the round's weights."""

    def __init__(self, start: np.ndarray, bias: np.ndarray, config: MaxentConfig) -> None:
        self.start, self.bias, self.config = start, bias, config
        self.own, self.squares, self.used = start.copy(), np.ones(len(start), np.float32), np.zeros(len(start), bool)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.room = np.empty((2, FEATURES * config.batch, WIDE), np.float32)

    def add(self, *columns: np.ndarray, last: bool = False) -> None:
        """Tokens' features, classes and times; steps are of `batch` tokens, however they come."""
        if columns:
            self.waiting.append(columns)
        if not self.waiting:
            return
        features, classes, times = (np.concatenate(x, -1) for x in zip(*self.waiting, strict=True))
        size = self.config.batch
        whole = len(classes) if last else len(classes) // size * size
        for begin in range(0, whole, size):
            part = slice(begin, min(begin + size, whole))
            sgd(self.own, self.squares, self.bias, features[:, part], classes[part], times[part], self.config, self.used, self.room)
        self.waiting = [(features[:, whole:], classes[whole:], times[whole:])] if whole < len(classes) else []

    def changes(self) -> pa.RecordBatch:
        self.add(last=True)
        at = np.flatnonzero(self.used)
        change = (self.own[at] - self.start[at]).astype(np.float16)
        parts = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // BLOCK)) + 1) if len(at) else []
        return pa.RecordBatch.from_arrays(
            [pa.array([int(at[p[0]]) // BLOCK for p in parts], pa.int32()), pa.array([at[p].astype(np.int32).tobytes() for p in parts], pa.binary()), pa.array([change[p].tobytes() for p in parts], pa.binary())],
            ["block", "at", "change"],
        )


def _mean_changes(batches):
    """The mean change of each row of weights, over the shards that used it."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, change in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("change"), strict=True):
            if block not in sums:
                sums[block], counts[block] = np.zeros((BLOCK, WIDE)), np.zeros(BLOCK, np.int64)
            rows = np.frombuffer(at.as_py(), np.int32) - block * BLOCK
            sums[block][rows] += np.frombuffer(change.as_py(), np.float16).reshape(len(rows), WIDE)
            counts[block][rows] += 1
    for block in sorted(sums):
        at = np.flatnonzero(counts[block])
        mean = (sums[block][at] / counts[block][at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(at + block * BLOCK).astype(np.int32).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "at", "change"])


#: A text with more than one in so many rows is trained once with its number.
HOT_TEXTS = 1024


def train(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """The weights (FEATURES * buckets x WIDE)."""
    config = words.config
    spark = texts.sparkSession
    weights = np.zeros((FEATURES * config.buckets, WIDE), np.float32)
    lean = Vocabulary(words.total, words.distinct, np.zeros(0, np.uint64), np.zeros(0, np.int64), words.top, words.top_class, words.top_count, words.class_total, config)
    shards = min(max(-(-words.total // (config.rounds * config.shard_tokens)), 1), config.max_shards)
    placed = texts.select("txt", F.xxhash64("txt", F.lit(17)).alias("h"))
    sizes = placed.groupBy("h").agg(F.count(F.lit(1)).alias("of"))
    hot = sizes.where(F.col("of") * HOT_TEXTS > texts.count()).select("h").collect()  # HOT_TEXTS rows at most
    dealt = placed.withColumn("times", F.lit(1).cast("long"))
    if hot:
        hot = F.broadcast(spark.createDataFrame(hot, "h long"))
        many = cut(placed.join(hot, "h", "left_semi").groupBy("h", "txt").agg(F.count(F.lit(1)).alias("times")))
        dealt = dealt.join(hot, "h", "left_anti").select("txt", "h", "times").unionByName(many)
    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int"))
    schema = "block int, at binary, change binary"
    for n_round in range(config.rounds):
        shared = spark.sparkContext.broadcast((weights, lean))

        def steps(batches, shared=shared):
            start, words = shared.value
            bias, shard, at = _bias(words), None, None
            for batch in batches:
                shards = batch.column("shard").to_numpy(zero_copy_only=False)
                bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for begin, stop in zip(bounds, bounds[1:], strict=False):
                    if begin == stop:
                        continue
                    if shards[begin] != at:
                        if shard:
                            yield shard.changes()
                        shard, at = _Shard(start, bias, words.config), shards[begin]
                    part = batch.slice(begin, stop - begin)
                    times = part.column("times").to_numpy(zero_copy_only=False).astype(np.float32)
                    for first, last, data, offs in tb.chunks(part.column("txt")):
                        rows, hashes, classes = prepared(data, offs, words)
                        shard.add(contexts(rows, hashes, classes), classes, times[first:last][rows])
            if shard:
                yield shard.changes()

        # more partitions than shards, so that few hold two; rows of a shard stand in the order of their hashes
        picked = dealt.where(F.pmod("h", F.lit(config.rounds)) == n_round).repartition(4 * shards, "shard").sortWithinPartitions("shard", "h", "txt")
        changes = picked.select("shard", "txt", "times").mapInArrow(tb.tidy(steps), schema)
        # each block of rows is added up in one place, so the driver gets no more than the weights
        for row in changes.repartition(FEATURES * config.buckets // BLOCK, "block").mapInArrow(tb.tidy(_mean_changes), schema).collect():
            at = np.frombuffer(row["at"], np.int32)
            weights[at] += np.frombuffer(row["change"], np.float32).reshape(len(at), WIDE)
        shared.unpersist()
    return weights


def _scoring(shared):
    def run(batches):
        weights, words = shared.value
        config = words.config
        bias = _bias(words)
        log_total = np.log10(np.maximum(words.class_total, 1))
        # a class of one word has no factor of its own; the word's count is in the class
        single = np.arange(LEAVES) < SINGLE
        starts = _starts(words.hot)
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt")):
                n = last - first
                rows, hashes, classes = prepared(data, offs, words)
                value = np.zeros(len(rows))
                for begin in range(0, len(rows), 4096):
                    stop = min(begin + 4096, len(rows))
                    reach = max(0, begin - 3)
                    features = contexts(rows[reach:stop], hashes[reach:stop], classes[reach:stop])[:, begin - reach :]
                    value[begin:stop] = log_chance(weights, bias, features, classes[begin:stop], config.buckets)
                value *= 1 / math.log(10)
                # most tokens are words that are classes of their own; the others are looked up
                count = words.top_count[np.where(single[classes], classes, 0)]
                others = np.flatnonzero(~single[classes])
                count[others] = _lookup(words.hot, words.hot_count, hashes[others], -1, starts)
                known = count >= 0  # the end is known without a training text too, with a count of none
                log_count = np.log10(np.maximum(count, 0) + 1)
                value += np.where(single[classes], 0.0, np.where(known, log_count, 0.0) - log_total[classes])
                at = np.searchsorted(rows, np.arange(n + 1))
                score, base = tb.segment_sums(value, at), tb.segment_sums(np.where(known, log_count, 0.0), at)
                n_known = tb.segment_sums(known & (count > 0), at)
                # words whose counts aren't here: each text's distinct ones with how often it has them
                cold = np.flatnonzero(~known)
                order = cold[np.lexsort((hashes[cold], rows[cold]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(order)))
                bounds = np.searchsorted(rows[order][begin], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (hashes[order][begin].view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("id")[first:last], batch.column("mark")[first:last], pa.array(np.diff(at)), pa.array(n_known), pa.array(base), pa.array(score), *lists], ["id", "mark", "n_tokens", "n_known", "base", "score", "cold", "times"])

    return run


def score(docs: DataFrame, training: Column, config: MaxentConfig = MaxentConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; learns from rows where `training` is true."""
    spark = ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("id"), (~F.coalesce(training, F.lit(False))).alias("mark"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt"))
    kind = base.schema["id"].dataType.simpleString()
    texts = base.where(~F.col("mark")).select("txt")
    words = count_words(texts, config)
    weights = train(texts, words)
    counts, words.counts = words.counts, None
    shared = spark.sparkContext.broadcast((weights, words))
    partial = cut(base.mapInArrow(tb.tidy(_scoring(shared)), f"id {kind}, mark boolean, n_tokens long, n_known long, base double, score double, cold array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()))
    # rare words: no one has more than one in hot_bound of the training tokens
    cold = partial.select("row", F.explode(F.arrays_zip("cold", "times")).alias("c")).select("row", F.col("c.cold").alias("h"), F.col("c.times").alias("times"))
    rare = counts.where(F.col("n") * config.hot_bound < words.total).where(~F.col("h").isin([int(x) for x in words.top.view(np.int64)])).select("h", "n")
    # words that are rare or unseen in training may be frequent here; there are no more of them than hot_bound times this many tokens for one of training
    often = cold.groupBy("h").agg(F.sum("times").alias("m")).where(F.col("m") * config.hot_bound >= words.total).join(rare, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))
    often = cut(often)
    often = broadcast_if_small(often, often.count() * 16)
    met = cold.join(often, "h").where("n > 0").unionByName(cold.join(often.select("h"), "h", "left_anti").join(rare, "h"))
    # millionths of millionths, so that sums don't depend on their order
    added = met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.round(F.log10(F.col("n") + 1) * 1e9).cast("long")).alias("logs"))
    gain = F.coalesce(F.col("logs"), F.lit(0)) / F.lit(1e9)
    out = partial.drop("cold", "times").join(added, "row", "left")
    unit = math.log10(words.total + words.distinct + 1)
    return out.select(
        F.col("id").alias(doc_id), F.col("mark").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
