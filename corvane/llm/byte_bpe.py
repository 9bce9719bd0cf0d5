"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that the encoding of that prefix can end with. It is the token t for which the
encoding of the prefix before t ends with a token that may stand before t: one that BPE would leave apart from t. So a table of one
token a byte holds the encodings of all prefixes; appending bytes goes on from the table, and an edit re-encodes from its place only.

Two neighbouring tokens stay apart unless, while pieces on both sides of their border are alive, their concatenation is a token that
comes first. The pieces at the border are the right spine of one token's merge tree and the left spine of the other's.

Pre-tokens are cut in numpy; each distinct one is encoded once a worker, under a bound on what is kept, and ids are gathered in numpy.
Kept pieces are found by hash and compared by their bytes, so a clash of hashes changes nothing.

Defined results: a null or an empty text has no tokens and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textbatch as tb
from .pretokens import pretoken_ends, pretokens

#: Distinct pre-tokens that a worker keeps; beyond it forgets all and begins anew.
KEEP_PIECES = 500_000
#: Bytes of them at most, before what a chunk adds.
KEEP_BYTES = 1 << 24
#: Pairs of tokens whose border a worker remembers.
KEEP_PAIRS = 60_000
_NEVER = 1 << 30


class ByteBpe:
    """A vocabulary of byte strings by rank, with the merge tree of each token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._apart: dict[tuple[int, int], bool] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._reachable: set[int] = set()
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._reachable.add(r)
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a in self._reachable and b in self._reachable and max(a if cut > 1 else -1, b if len(token) - cut > 1 else -1) < r and self._stays_apart(a, b, r):
                    self.left[r], self.right[r] = a, b
                    self._reachable.add(r)
                    break

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        """Reads lines of base64 and rank."""
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def _stays_apart(self, x: int, y: int, before: int = _NEVER) -> bool:
        """Whether no merge across the border of x and y happens among merges that come before the given rank."""
        grown_x = grown_y = before  # when the pieces at the border are merged into larger ones
        while True:
            joint = self.rank.get(self.token[x] + self.token[y], _NEVER)
            if joint < before and joint < grown_x and joint <= grown_y:
                return False
            born_x, born_y = (x if x in self.right else -1), (y if y in self.left else -1)
            if born_x < 0 and born_y < 0:
                return True
            if born_x > born_y:
                grown_x, x = x, self.right[x]
            else:
                grown_y, y = y, self.left[y]

    def apart(self, x: int, y: int) -> bool:
        """Whether BPE leaves x and y as they are when they are all there is."""
        found = self._apart.get((x, y))
        if found is None:
            if len(self._apart) > KEEP_PAIRS:
                self._apart.clear()
            found = self._apart[x, y] = self._stays_apart(x, y)
        return found


class PrefixEncoding:
    """The last token of each prefix of a piece, exact after every append and edit."""

    def __init__(self, bpe: ByteBpe, piece: bytes = b"") -> None:
        self.bpe = bpe
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoding:
        """Goes on at the end; the work is that of the new bytes alone."""
        bpe, rank, last = self.bpe, self.bpe.rank, self.last
        known, apart, longest, reachable = bpe._apart, bpe.apart, bpe.longest, bpe._reachable
        at = len(self.piece)
        self.piece = s = self.piece + more
        for end in range(at + 1, len(s) + 1):
            for begin in range(max(0, end - longest), end):
                token = rank.get(s[begin:end])
                if token is None or token not in reachable:
                    continue
                if begin:
                    before = last[begin - 1]
                    fits = known.get((before, token))
                    if not (apart(before, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"the vocabulary lacks the byte {s[end - 1]}")
        return self

    def replace(self, begin: int, end: int, new: bytes) -> PrefixEncoding:
        """Puts `new` in place of piece[begin:end]; prefixes before `begin` stay as they are."""
        tail = new + self.piece[end:]
        self.piece, self.last = self.piece[:begin], self.last[:begin]
        return self.append(tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix up to `end`, or of the whole."""
        at, out = len(self.last) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.bpe.token[out[-1]])
        return out[::-1]


def encode_pieces(bpe: ByteBpe, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each piece; in sorted order each piece goes on from the table of the prefix that it shares with the one before."""
    out: list[list[int]] = [[]] * len(pieces)
    table = PrefixEncoding(bpe)
    for i in sorted(range(len(pieces)), key=pieces.__getitem__):
        piece, at = pieces[i], 0
        for a, b in zip(piece, table.piece, strict=False):
            if a != b:
                break
            at += 1
        out[i] = table.replace(at, len(table.piece), piece[at:]).ids()
    return out


class PieceStore:
    """Values of distinct pieces by their hash, as flat arrays; a lookup of many pieces is a sorted search.

    The bytes of the kept pieces are compared with those looked up. Pieces whose hash belongs to other bytes go by their bytes.
    """

    def __init__(self, compute, keep: int = KEEP_PIECES, kind: type = np.int64) -> None:
        self.compute, self.keep, self.kind = compute, keep, kind
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.values = np.zeros(0, self.kind)
        self.byte_offsets = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """The places of new pieces."""
        found = self.compute(pieces)
        places = (np.arange(len(pieces)) + len(self.offsets) - 1).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.values = np.concatenate([self.values, np.array([y for x in found for y in x], self.kind)])
        self.byte_offsets = np.concatenate([self.byte_offsets, self.byte_offsets[-1] + np.cumsum([len(x) for x in pieces], dtype=np.int64)])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        return places

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each piece's values; offsets and values hold them. The pieces are in order and leave no gap."""
        hashes, first, inverse = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > self.keep or len(self.bytes) > KEEP_BYTES:
            self._clear()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        raw = data.tobytes() if len(new) else b""
        if len(new):
            places = self._add([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.place = np.insert(self.place, at[new], places)
            at = np.searchsorted(self.hashes, hashes)
        found = self.place[at][inverse]
        same_size = self.byte_offsets[found + 1] - self.byte_offsets[found] == ends - starts
        if same_size.all() and np.array_equal(self.bytes[gather(self.byte_offsets, found)[0]], data[starts[0] : ends[-1]] if len(starts) else data[:0]):
            return found
        return self._by_bytes(data.tobytes(), starts, ends, found)

    def _by_bytes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The places, where some pieces have the hash of others: those get places that no hash leads to."""
        kept = self.bytes.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        bounds = self.byte_offsets
        wrong = [i for i, (piece, p) in enumerate(zip(pieces, found.tolist(), strict=True)) if kept[bounds[p] : bounds[p + 1]] != piece]
        own = sorted({pieces[i] for i in wrong})
        places = dict(zip(own, self._add(own).tolist(), strict=True))
        found = found.copy()
        found[wrong] = [places[pieces[i]] for i in wrong]
        return found


def gather(offsets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each value, length of each place's run): runs offsets[p]:offsets[p+1] one after another."""
    lengths = offsets[places + 1] - offsets[places]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets[places] - (ends - lengths), lengths), lengths


class BatchEncoder:
    """Encodes and decodes chunks of texts."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe
        self.store = PieceStore(lambda pieces: encode_pieces(bpe, pieces), kind=np.int32)
        n = max(bpe.token, default=-1) + 1
        lengths = np.array([len(bpe.token.get(i, b"")) for i in range(n)], np.int64)
        self.token_offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(bpe.token.get(i, b"") for i in range(n)), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.token_bytes[gather(self.token_offsets, ids)[0]]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows among them)."""
        rows, starts = pretokens(data, offs)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        places = self.store.lookup(data, starts, pretoken_ends(rows, starts, offs))
        at, lengths = gather(self.store.offsets, places)
        ids = self.store.values[at]
        counts = np.bincount(rows, weights=lengths, minlength=len(offs) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])


_ENCODERS: dict[str, BatchEncoder] = {}
_LOCK = threading.Lock()


def encoder(key: str, ranks: bytes) -> BatchEncoder:
    """The worker's encoder for a vocabulary file's content, built once."""
    with _LOCK:
        if key not in _ENCODERS:
            pairs = (line.split() for line in ranks.splitlines() if line)
            _ENCODERS[key] = BatchEncoder(ByteBpe({base64.b64decode(a): int(b) for a, b in pairs}))
        return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """The columns `keep` of each row with n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256; `ids`: the ids too.

    vocabulary: path of a file of base64 and rank on the driver; its content travels by broadcast.
    """
    spark = ship(docs.sparkSession)
    content = Path(vocabulary).read_bytes()
    key = hashlib.sha256(content).hexdigest()
    shared = spark.sparkContext.broadcast(content)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("txt"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        coder = _ENCODERS.get(key) or encoder(key, shared.value)
        for batch in batches:
            for first, last, data, offs in tb.chunks(batch.column("txt")):
                found, at = coder.encode(data, offs)
                packed = memoryview(found.astype("<u4").tobytes())
                decoded = memoryview(coder.decode(found).tobytes())
                bounds, ends = (at * 4).tolist(), offs.tolist()
                digest = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                back = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                columns = [*(batch.column(c)[first:last] for c in names), pa.array(np.diff(at)), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields, strict=False))
    return frame.mapInArrow(tb.tidy(run), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
