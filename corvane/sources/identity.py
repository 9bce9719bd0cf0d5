"""Identities of contents and of the inputs of a scan: weak ones that tell what to read again, never what is the same."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Starts and factors of the three lanes.
STARTS = (0xCBF29CE484222325, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FACTORS = (0x100000001B3, 0x9E3779B185EBCA87, 0x1000000001B3, 0xBF58476D1CE4E5B9)


def weak_identities(contents: list[bytes]) -> list[str]:
    """length:lane:lane:lane in hex of each content: each byte is mixed into three 64-bit lanes with its position, for all contents at once."""
    order = sorted(range(len(contents)), key=lambda i: -len(contents[i]))
    sizes = np.array([len(contents[i]) for i in order], np.int64)
    width = int(sizes.max(initial=0))
    lanes = [np.full(len(order), s, np.uint64) for s in STARTS]
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    block = 4096
    for begin in range(0, width, block):
        live = int((sizes > begin).sum())
        part = np.zeros((live, min(block, width - begin)), np.uint8)
        for row, i in enumerate(order[:live]):
            piece = np.frombuffer(contents[i][begin : begin + block], np.uint8)
            part[row, : len(piece)] = piece
        for at in range(part.shape[1]):
            place = np.uint64(begin + at)
            n = int((sizes > begin + at).sum())
            byte = part[:n, at].astype(np.uint64)
            a, b, c = (lane[:n] for lane in lanes)
            a[:] = a * np.uint64(FACTORS[0]) + (byte ^ turn(place, 17))
            b[:] = turn(b ^ (byte + place), 13) * np.uint64(FACTORS[1])
            c[:] = turn(c + byte * np.uint64(FACTORS[2]), 29) ^ np.uint64(int(place) * FACTORS[3] & ((1 << 64) - 1))
    out = [""] * len(order)
    for row, i in enumerate(order):
        out[i] = f"{sizes[row]:x}:" + ":".join(f"{int(lane[row]):016x}" for lane in lanes)
    return out


def with_weak_identity(files: DataFrame, content: str = "content", out: str = "identity") -> DataFrame:
    """Adds the weak identity of a binary column; equal identities are a reason to read again, not a proof."""
    ship(files.sparkSession)
    made = F.pandas_udf(lambda column: pd.Series(weak_identities([b"" if c is None else bytes(c) for c in column])), "string")
    return files.withColumn(out, made(F.col(content)))


def input_fingerprint(schema: str, parser: str, profile: str, config: dict[str, object], defaults: dict[str, dict[str, str]], ignore: str) -> dict[str, str]:
    """SHA-256 of each input of a scan; metadata of an earlier scan counts only if all are the same."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    listed = ";".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in sorted(config.items()))
    package = "\n".join(f"{folder}\t{key}\t{value}" for folder, facts in sorted(defaults.items()) for key, value in sorted(facts.items()))
    return {"schema": digest(schema), "parser": digest(parser), "profile": digest(profile), "config": digest(listed), "package_defaults": digest(package), "ignore": digest(ignore)}


def scan_changed(previous: DataFrame, current: DataFrame, changed: list[str], same_inputs: bool) -> DataFrame:
    """(path, state, sha256): the state after a scan that reads `changed` paths only; other paths keep their digest, unless an input differs, then all are read.

    previous: path, sha256; current: path, sha256 of what is there now.
    """
    old = previous.select("path", F.col("sha256").alias("old"))
    both = old.join(current.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    named = F.col("path").isin(changed) if changed else F.lit(False)
    read = named if same_inputs else F.lit(True)
    now = F.when(read, F.col("new")).otherwise(F.coalesce("old", F.when(named, F.col("new"))))
    rows = both.withColumn("now", now).where("old is not null or now is not null")
    state = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old") == F.col("now"), "reused").otherwise("changed")
    return rows.select("path", state.alias("state"), F.col("now").alias("sha256"))
