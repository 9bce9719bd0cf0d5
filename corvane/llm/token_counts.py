"""Token counts under a unigram model, with forward scores in a trie of distinct pre-tokens.

The model takes a vocabulary of byte strings by rank; the probability of a token falls as a power of its rank (Zipf), which needs no training. The
best segmentation of a pre-token has the largest product of probabilities, of equal ones that with fewer tokens. Distinct pre-tokens go into a
trie. A node's forward score is the best over tokens that end there, of the score of the node where the token begins plus the
token's; it is computed once for all pre-tokens that share the prefix. Terminal nodes hold the count of tokens.

Scores are whole numbers of millionths, so sums don't depend on their order.

Defined results: a null or an empty text has no tokens and score 0. A byte that the vocabulary lacks costs `unknown` and one token.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textbatch as tb
from .byte_bpe import PieceStore
from .pretokens import pretoken_ends, pretokens

#: Nodes that a worker's trie may have; beyond it the trie begins anew.
TRIE_NODES = 150_000


@dataclass(frozen=True)
class UnigramConfig:
    """exponent and shift of the power law over ranks; unknown: the cost of a byte without a token, in millionths."""

    exponent: float = 1.0
    shift: float = 2.7
    unknown: int = -30_000_000


def unigram_scores(ranks: dict[bytes, int], config: UnigramConfig = UnigramConfig()) -> dict[bytes, int]:
    """The log-probability of each token in millionths."""
    weights = {t: (r + config.shift) ** -config.exponent for t, r in ranks.items()}
    total = math.fsum(weights.values())
    return {t: round(1e6 * math.log(w / total)) for t, w in weights.items()}


class ForwardTrie:
    """A trie with the forward score and the token count of the best segmentation at each node."""

    def __init__(self, scores: dict[bytes, int], unknown: int = UnigramConfig.unknown, max_nodes: int = TRIE_NODES) -> None:
        self.scores, self.unknown, self.max_nodes = scores, unknown, max_nodes
        self.longest = max(map(len, scores), default=1)
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[tuple[int, int]] = [(0, 0)]  # (score, minus the number of tokens)

    def insert(self, piece: bytes) -> tuple[int, int]:
        """(number of tokens, score) of a pre-token; nodes that it shares with others are not computed again."""
        if len(self.best) > self.max_nodes:
            self._clear()
        child, best, scores = self.child, self.best, self.scores
        node, path = 0, [0]
        for end, byte in enumerate(piece, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                score, minus = best[path[end - 1]]
                top = (score + self.unknown, minus - 1) if piece[end - 1 : end] not in scores else (-(1 << 62), 0)
                for begin in range(max(0, end - self.longest), end):
                    own = scores.get(piece[begin:end])
                    if own is not None:
                        score, minus = best[path[begin]]
                        if (score + own, minus - 1) > top:
                            top = (score + own, minus - 1)
                node = child[key] = len(best)
                best.append(top)
            path.append(node)
        return -best[node][1], best[node][0]


_STORES: dict[str, PieceStore] = {}


def count(docs: DataFrame, vocabulary: str, config: UnigramConfig = UnigramConfig(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of each row with n_pretokens, n_tokens and log_prob (natural logarithm of the best segmentations)."""
    spark = ship(docs.sparkSession)
    content = Path(vocabulary).read_bytes()
    key = f"{hashlib.sha256(content).hexdigest()} {config}"
    shared = spark.sparkContext.broadcast(content)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("txt"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        if key not in _STORES:
            pairs = (line.split() for line in shared.value.splitlines() if line)
            trie = ForwardTrie(unigram_scores({base64.b64decode(a): int(b) for a, b in pairs}, config), config.unknown)
            _STORES[key] = PieceStore(lambda pieces: [trie.insert(p) for p in pieces])
        store = _STORES[key]
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt")):
                rows, starts = pretokens(data, offs)
                at = np.searchsorted(rows, np.arange(len(offs)))
                sums = np.zeros((last - first, 2), np.int64)
                if len(rows):
                    places = store.lookup(data, starts, pretoken_ends(rows, starts, offs))
                    place = store.offsets[places]
                    sums = tb.segment_sums(np.stack([store.values[place], store.values[place + 1]], 1), at)
                columns = [*(batch.column(c)[first:last] for c in names), pa.array(np.diff(at)), pa.array(sums[:, 0]), pa.array(sums[:, 1] / 1e6)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_pretokens", "n_tokens", "log_prob"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=False))
    return frame.mapInArrow(tb.tidy(run), f"{fields}, n_pretokens long, n_tokens long, log_prob double").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
