"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts marked good; unlabelled ones are all training texts. With the class prior p, the sigmoid loss l and a score g the risk is
p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]): where the second part falls below zero, a step is taken that raises it, so the model can't fit the
unlabelled texts as if they were all bad. The prior is estimated from the data: a classifier tells one half of the positives from unlabelled texts;
its mean output over unlabelled texts, as a part of its median over the other half, is the share of positives among them. Labels of bad texts aren't used.

Features are ratios of kinds of characters, lengths of words and lines, repetition of words, lines and word pairs, and hashed byte pairs. They are
computed for whole texts in numpy; the model is linear with crossed bins, small, and travels by broadcast.

No text is left out: the features of all positives and of all unlabelled texts are summed up in cells, 2 ** bits of each kind, whose borders are random planes
through the mean of the positives. A cell stands in the risk with its mean and its number of texts. Sums are whole numbers, so neither order
nor partitions matter; the driver gets the cells alone and takes the same number of full steps over them at every size.

Defined results: a null or an empty text is scored by its features, all zero. Equal texts get equal scores. Without a positive every score is 0.5.
Labels of one id that differ: one that says good counts. Rows that repeat an id or a text count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, ship
from . import textbatch as tb

#: Edges of bins; each dense feature becomes one column a bin, plus itself.
BINS = np.array([0.001, 0.003, 0.01, 0.02, 0.035, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 0.9])
DENSE = 16
PAIRS = 256


@dataclass(frozen=True)
class QualityConfig:
    """bits: planes that cut texts into cells. steps, rate, penalty: of the risk's descent. prior_penalty: of the classifier that estimates the prior. seed: of the planes."""

    bits: int = 11
    steps: int = 400
    rate: float = 0.1
    penalty: float = 5e-3
    prior_penalty: float = 2e-2
    seed: int = 7


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: float


def dense_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ratios in 0..1 for each row (rows x DENSE)."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(float)
    out = np.zeros((n, DENSE))
    if not len(data):
        return out
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high = (data >= 48) & (data <= 57), data >= 128
    space = ~tb.non_space_bytes()[data]
    sign = ~(upper | lower | digit | high | space)
    plain = np.isin(data, np.frombuffer(b".,;:'\"-()?", np.uint8))
    share = lambda mask: tb.segment_sums(mask.astype(np.int64), offs) / size
    out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = share(upper), share(digit), share(high), share(sign), share(sign & ~plain)
    out[:, 5] = share(data == ord("!"))
    out[:, 6] = share(data == ord("|"))
    rows, starts, ends = tb.words(data, offs, tb.non_space_bytes())
    counts = np.maximum(np.bincount(rows, minlength=n), 1)
    word = tb.span_hashes(data, starts, ends)
    lengths = ends - starts
    mean = np.bincount(rows, weights=lengths, minlength=n) / counts
    out[:, 7] = np.minimum(mean / 20, 1)

    def repeated(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The share of entries that have come before in their row."""
        if not len(keys):
            return np.zeros(n)
        mixed = tb.mix(keys + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.unique(mixed, return_index=True)[1]
        total = np.bincount(at, minlength=n)
        return 1 - np.bincount(at[first], minlength=n) / np.maximum(total, 1) - (total == 0)

    out[:, 8] = repeated(word, rows)
    same = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    out[:, 9] = repeated(tb.mix(word[:-1] * np.uint64(3) + word[1:])[same], rows[1:][same]) if len(rows) > 1 else 0
    out[:, 10] = np.bincount(rows[1:][same & (word[1:] == word[:-1])], minlength=n) / counts if len(rows) > 1 else 0
    is_line = np.ones(256, bool)
    is_line[10] = False
    line_rows, line_starts, line_ends = tb.words(data, offs, is_line)
    out[:, 11] = repeated(tb.span_hashes(data, line_starts, line_ends), line_rows)
    last = data[ends - 1] if len(ends) else data[:0]
    out[:, 12] = np.bincount(rows, weights=np.isin(last, np.frombuffer(b".?", np.uint8)), minlength=n) / counts
    out[:, 13] = np.bincount(rows, weights=~tb.letter_or_digit_bytes()[tb.lower_ascii(last)] & ~np.isin(last, np.frombuffer(b".,;:?", np.uint8)), minlength=n) / counts
    out[:, 14] = np.minimum(np.log1p(counts) / 12, 1)
    out[:, 15] = 1.0 / np.sqrt(counts)
    return out


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dense features, their bins, and shares of hashed byte pairs."""
    n = len(offs) - 1
    dense = dense_features(data, offs)
    bins = (np.searchsorted(BINS, dense, "right")[:, :, None] == np.arange(len(BINS) + 1)).reshape(n, -1)
    pairs = np.zeros((n, PAIRS))
    if len(data) > 1:
        rows = np.repeat(np.arange(n), np.diff(offs))
        inside = rows[1:] == rows[:-1]
        bucket = (tb.lower_ascii(data[:-1]).astype(np.int64) * 31 + tb.lower_ascii(data[1:]) * 7) % PAIRS
        pairs = np.bincount((rows[1:] * PAIRS + bucket)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / np.maximum(np.diff(offs), 1)[:, None]
    return np.concatenate([dense, bins, 4 * np.sqrt(pairs)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Cells:
    """Means of features (cells x features) with their numbers of texts."""

    x: np.ndarray
    n: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.n / self.n.sum()


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def nnpu(positive: Cells, unlabelled: Cells, prior: float, config: QualityConfig) -> QualityModel:
    """A linear model of the least non-negative risk with the sigmoid loss, by Adam over all cells from a zero model with the prior's bias."""
    p, u = _with_one(positive.x), _with_one(unlabelled.x)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    penalty = np.full(len(w), config.penalty)
    penalty[-1] = 0
    for t in range(1, config.steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        # slopes of the means of losses: positives as bad (as good: the same downwards), unlabelled as bad
        bad = (positive.share * sp * (1 - sp)) @ p
        other = (unlabelled.share * su * (1 - su)) @ u
        negative = unlabelled.share @ su - prior * (positive.share @ sp)
        slope = (other - 2 * prior * bad if negative >= 0 else prior * bad - other) + penalty * w
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        w = w - config.rate * (1 - t / config.steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return QualityModel(w[:-1], float(w[-1]), prior)


def _told_apart(positive: Cells, unlabelled: Cells, penalty: float) -> np.ndarray:
    """Weights of the logistic classifier of positives against unlabelled texts, both kinds of the same weight, by Newton's method."""
    x = np.concatenate([_with_one(positive.x), _with_one(unlabelled.x)])
    y = np.concatenate([np.ones(len(positive.x)), np.zeros(len(unlabelled.x))])
    share = np.concatenate([positive.share, unlabelled.share]) / 2
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(12):
        s = _sigmoid(x @ w)
        w = w - np.linalg.solve((x * (share * s * (1 - s))[:, None]).T @ x + np.diag(ridge), x.T @ (share * (s - y)) + ridge * w)
    return w


def estimate_prior(halves: tuple[Cells, Cells], unlabelled: Cells, config: QualityConfig) -> float:
    """The share of positives among unlabelled texts: the mean over both halves of the positives as the ones that are learned."""
    found = []
    for learned, kept in (halves, halves[::-1]):
        w = _told_apart(learned, unlabelled, config.prior_penalty)
        out = _sigmoid(_with_one(kept.x) @ w)
        order = np.argsort(out, kind="stable")
        median = out[order][min(np.searchsorted(np.cumsum(kept.share[order]), 0.5), len(out) - 1)]
        found.append(unlabelled.share @ _sigmoid(_with_one(unlabelled.x) @ w) / max(median, 1e-6))
    return float(np.clip(np.mean(found), 0.05, 0.97))


#: Features are added up in whole parts of one.
UNIT = 1 << 24
WIDTH = DENSE * (len(BINS) + 2) + PAIRS

_CELL = "kind int, cell int, n long, sums binary"


def _cell_batch(found: dict[tuple[int, int], list]) -> pa.RecordBatch:
    keys = sorted(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1].tobytes() for k in keys], pa.binary())],
        ["kind", "cell", "n", "sums"],
    )


def _celled(planes: np.ndarray, bounds: np.ndarray):
    """Sums features of rows (txt, kind) by kind and cell; kind 0 is unlabelled, 1 and 2 are halves of the positives, whose rows are unlabelled ones too."""

    def run(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt"), rows=4096):
                x = features(data, offs)
                cell = (x @ planes > bounds) @ (1 << np.arange(planes.shape[1]))
                whole = np.rint(x * UNIT).astype(np.int64)
                kinds = batch.column("kind")[first:last].to_numpy(zero_copy_only=False)
                for kind in (0, 1, 2):
                    own = np.arange(last - first) if kind == 0 else np.flatnonzero(kinds == kind)
                    own = own[np.argsort(cell[own], kind="stable")]
                    begin = np.flatnonzero(np.append(True, cell[own][1:] != cell[own][:-1])) if len(own) else own
                    for at, n, sums in zip(cell[own][begin].tolist(), np.diff(np.append(begin, len(own))).tolist(), np.add.reduceat(whole[own], begin, axis=0) if len(own) else [], strict=True):
                        held = found.setdefault((kind, at), [0, np.zeros(WIDTH, np.int64)])
                        held[0] += n
                        held[1] += sums
        if found:
            yield _cell_batch(found)

    return run


def _added(batches):
    """Adds up the sums of equal cells."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for kind, at, n, sums in zip(*(batch.column(c).to_pylist() for c in ("kind", "cell", "n", "sums")), strict=True):
            held = found.setdefault((kind, at), [0, np.zeros(WIDTH, np.int64)])
            held[0] += n
            held[1] += np.frombuffer(sums, np.int64)
    if found:
        yield _cell_batch(found)


def _cells(frame: DataFrame, planes: np.ndarray, bounds: np.ndarray) -> dict[int, Cells]:
    """The cells of each kind of rows (txt, kind); so many rows at most as there are cells come to the driver."""
    parts = frame.mapInArrow(tb.tidy(_celled(planes, bounds)), _CELL).repartition(8, "kind", "cell").mapInArrow(_added, _CELL)
    rows = sorted(parts.collect(), key=lambda r: (r["kind"], r["cell"]))
    out = {}
    for kind in {r["kind"] for r in rows}:
        n = np.array([r["n"] for r in rows if r["kind"] == kind], np.int64)
        sums = np.stack([np.frombuffer(r["sums"], np.int64) for r in rows if r["kind"] == kind])
        out[kind] = Cells(sums / UNIT / n[:, None], n)
    return out


def train(texts: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learns from `texts` and the labels of the same rows: those marked 1 are the positives, all texts are the unlabelled ones."""
    ship(texts.sparkSession)
    good = labels.where(F.col(doc_id).isNotNull() & (F.col(label) == 1)).select(F.col(doc_id).alias("id")).distinct().withColumn("good", F.lit(True))
    base = texts.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt"))
    half = F.when(F.col("good"), F.pmod(F.xxhash64("txt"), F.lit(2)) + 1).otherwise(0).cast("int")
    marked = base.join(broadcast_if_small(good, good.count() * 16), "id", "left").select("txt", half.alias("kind"))
    none = np.zeros((WIDTH, 0))
    centre = _cells(marked.where("kind > 0"), none, np.zeros(0))
    if not centre:
        return QualityModel(np.zeros(WIDTH), 0.0, 0.5)
    planes = np.random.default_rng(config.seed).normal(size=(WIDTH, config.bits))
    cells = _cells(marked, planes, centre[0].x[0] @ planes)
    halves = [cells[k] for k in (1, 2) if k in cells]
    positive = Cells(np.concatenate([h.x for h in halves]), np.concatenate([h.n for h in halves]))
    prior = estimate_prior((halves[0], halves[-1]), cells[0], config)
    return nnpu(positive, cells[0], prior, config)


def predict(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of each row with score (0 to 1) and predicted."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt"), rows=4096):
                score = np.round(_sigmoid((features(data, offs) * m.weights).sum(1) + m.bias), 6)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in names), pa.array(score)], [*names, "score"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=False))
    out = frame.mapInArrow(tb.tidy(run), f"{fields}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
