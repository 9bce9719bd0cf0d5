"""Stores and exports: content-addressed results, canonical JSON, envelopes, a vault of Markdown pages, git revisions, advisor replies."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StoreError(RuntimeError):
    """A store over its quota, or with damaged content."""


class FileStore:
    """Bytes by their SHA-256 below a folder, with a quota; content is checked on reading."""

    def __init__(self, root: str, max_bytes: int = 64 << 20) -> None:
        self.root, self.max_bytes = Path(root), max_bytes
        self.root.mkdir(parents=True, exist_ok=True)

    def used(self) -> int:
        """Bytes in the store."""
        return sum(p.stat().st_size for p in self.root.iterdir() if p.is_file())

    def put(self, data: bytes) -> str:
        """Stores bytes once; returns their id."""
        key = hashlib.sha256(data).hexdigest()
        target = self.root / key
        if not target.exists():
            if self.used() + len(data) > self.max_bytes:
                raise StoreError("quota")
            part = self.root / f".{key}.part"
            part.write_bytes(data)
            part.replace(target)
        return key

    def get(self, key: str) -> bytes | None:
        """The bytes of an id, None if absent."""
        if not re.fullmatch("[0-9a-f]{64}", key) or not (self.root / key).exists():
            return None
        data = (self.root / key).read_bytes()
        if hashlib.sha256(data).hexdigest() != key:
            raise StoreError("damaged")
        return data


class ResultStore(FileStore):
    """A file store with ages: a batch is published as a whole or not at all, and the oldest results make room."""

    def __init__(self, root: str, max_bytes: int = 64 << 20, max_entries: int = 256, max_age: int = 1_000) -> None:
        super().__init__(root, max_bytes)
        self.max_entries, self.max_age = max_entries, max_age

    def _ticks(self) -> dict[str, int]:
        index = self.root / "index.json"
        return json.loads(index.read_text()) if index.exists() else {}

    def used(self) -> int:
        """Bytes of results."""
        return sum((self.root / k).stat().st_size for k in self._ticks())

    def put_batch(self, payloads: list[bytes], now: int) -> list[str]:
        """Ids of the payloads, all stored at tick `now`; raises StoreError, and changes nothing, where they don't fit even alone."""
        keys = [hashlib.sha256(p).hexdigest() for p in payloads]
        new = dict(zip(keys, payloads, strict=True))
        if len(new) > self.max_entries or sum(map(len, new.values())) > self.max_bytes:
            raise StoreError("quota")
        before = self._ticks()
        old = {k: t for k, t in before.items() if now - t < self.max_age and k not in new}
        room, bytes_left = self.max_entries - len(new), self.max_bytes - sum(map(len, new.values()))
        kept: dict[str, int] = {}
        for key in sorted(old, key=lambda k: (-old[k], k)):
            size = (self.root / key).stat().st_size
            if len(kept) >= room or size > bytes_left:
                break
            kept[key], bytes_left = old[key], bytes_left - size
        written = []
        try:
            for key, data in new.items():
                if not (self.root / key).exists():
                    part = self.root / f".{key}.part"
                    part.write_bytes(data)
                    part.replace(self.root / key)
                    written.append(key)
            index = self.root / ".index.part"
            index.write_text(json.dumps({**kept, **dict.fromkeys(new, now)}, sort_keys=True))
            index.replace(self.root / "index.json")
        except OSError as reason:
            for key in written:
                (self.root / key).unlink(missing_ok=True)
            raise StoreError(str(reason)) from reason
        for key in set(before) - set(kept) - set(new):
            (self.root / key).unlink(missing_ok=True)
        return keys


def result_rows(frame: DataFrame) -> DataFrame:
    """(id, payload): rows as canonical JSON with their SHA-256."""
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(frame.columns)]))
    return frame.select(payload.alias("payload")).select(F.sha2(F.encode("payload", "UTF-8"), 256).alias("id"), "payload").distinct()


def canonical_yaml(value: object) -> object:
    """A header's value with its type beside it, so that equal forms are equal values: {"type": ..., "value": ...} at every level."""
    if value is None:
        return {"type": "null"}
    if isinstance(value, bool):
        return {"type": "bool", "value": value}
    if isinstance(value, int | float):
        return {"type": "number", "value": str(value)}
    if isinstance(value, list):
        return {"type": "sequence", "value": [canonical_yaml(x) for x in value]}
    if isinstance(value, dict):
        return {"type": "mapping", "value": {k: canonical_yaml(v) for k, v in value.items()}}
    return {"type": "string", "value": str(value)}


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; floats are refused."""

    def check(x: object) -> None:
        if isinstance(x, float):
            raise ValueError("floats have no canonical form")
        for inner in x.values() if isinstance(x, dict) else x if isinstance(x, list) else []:
            check(inner)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_canonical(text: str) -> object:
    """Reads JSON; doubled keys are refused."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key is doubled")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def brief_record(roots: list[str], revisions: list[str | None], question: str, top: int, outcome: str, matched: list[str], unmatched: list[str], rankings: list[dict], digests: list[str]) -> tuple[str, str]:
    """(id, text) of what is stored of a brief: a canonical record, whose id is its SHA-256; digests are those of the ranked files, zeros for missing ones."""
    if len(digests) != len(rankings) or any(not re.fullmatch("[0-9a-f]{64}", d) for d in digests):
        raise ValueError("a digest for each ranking")
    text = canonical_json({"schema_version": 1, "kind": "brief", "roots": roots, "revisions": revisions, "question": question, "top": top, "outcome": outcome, "matched": sorted(matched), "unmatched": sorted(unmatched), "rankings": [{**r, "content_digest": d} for r, d in zip(rankings, digests, strict=True)]})
    return hashlib.sha256(text.encode()).hexdigest(), text


def bundle_digest(docs: DataFrame) -> DataFrame:
    """(path, digest): digest of each document's canonical form; equal bundles have equal rows."""
    form = F.to_json(F.struct("path", F.coalesce("text", F.lit("")).alias("text")))
    return docs.select("path", F.sha2(F.encode(form, "UTF-8"), 256).alias("digest"))


def envelope(spark: SparkSession, command: str, status: str, data: DataFrame, warnings: list[str] | None = None, failures: list[str] | None = None, limit: int = 4096) -> DataFrame:
    """One row of JSON with schema_version, command, status, data, warnings and failures; data has at most `limit` rows."""
    rows = data.limit(limit).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*data.columns)))).alias("rows"))
    head = {"schema_version": 1, "command": command, "status": status, "warnings": warnings or [], "failures": failures or []}
    return rows.select(F.concat(F.lit(canonical_json(head)[:-1] + ',"data":'), F.coalesce("rows", F.lit("[]")), F.lit("}")).alias("json"))


def vault_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, text): a Markdown page for each node with a header, its facts, and links along its edges."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    linked = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "relationship", F.lit(": [["), safe(F.col("dst")), F.lit("]]")))).alias("links"))
    rows = nodes.join(linked, "id", "left")
    text = F.concat(F.lit("---\nid: "), "id", F.lit("\nrole: "), "role", F.lit("\n---\n"), F.array_join(F.coalesce("links", F.array().cast("array<string>")), "\n"), F.lit("\n"))
    return rows.select(F.concat(safe(F.col("id")), F.lit(".md")).alias("path"), text.alias("text"))


def read_vault(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, role) nodes and (src, relationship, dst page) edges back out of pages."""
    nodes = pages.select("path", F.regexp_extract("text", "(?m)^id: (.*)$", 1).alias("id"), F.regexp_extract("text", "(?m)^role: (.*)$", 1).alias("role"))
    lines = pages.select(F.regexp_extract("text", "(?m)^id: (.*)$", 1).alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- ([a-z-]+: \[\[[^\]]+\]\])$"), F.lit(1))).alias("l"))
    return nodes, lines.select("src", F.regexp_extract("l", "^([a-z-]+):", 1).alias("relationship"), F.regexp_extract("l", r"\[\[([^\]]+)\]\]", 1).alias("target"))


def git_revision(root: str) -> str | None:
    """The commit that HEAD names, by reading files; None outside a repository."""
    folder = Path(root) / ".git"
    try:
        head = (folder / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head if re.fullmatch("[0-9a-f]{40}", head) else None
        ref = head[5:]
        if (folder / ref).exists():
            return (folder / ref).read_text().strip()
        for line in (folder / "packed-refs").read_text().splitlines():
            if line.endswith(f" {ref}"):
                return line.split(" ")[0]
    except OSError:
        return None
    return None


def apply_advice(ranked: DataFrame, reply: str) -> DataFrame:
    """A ranking in the order of an advisor's reply: {"paths": [...]} or {"scores": {path: 0..1}}; any fault keeps the order that was there."""
    known = {r["path"] for r in ranked.select("path").collect()}
    try:
        value = parse_canonical(reply)
        if set(value) == {"paths"}:
            paths = value["paths"]
            if not paths or len(set(paths)) < len(paths) or not set(paths) <= known:
                return ranked
            place = ranked.sparkSession.createDataFrame(list(enumerate(paths, 1)), "place int, path string")
            return ranked.drop("rank").join(F.broadcast(place), "path").withColumnRenamed("place", "rank")
        if set(value) == {"scores"}:
            scores = value["scores"]
            if not scores or not set(scores) <= known or not all(isinstance(v, int | float) and 0 <= v <= 1 for v in scores.values()):
                return ranked
            given = ranked.sparkSession.createDataFrame([(k, float(v)) for k, v in scores.items()], "path string, advice double")
            rows = ranked.join(F.broadcast(given), "path", "left").withColumnRenamed("rank", "before")
            return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("advice"), "before"))).drop("advice", "before")
    except (ValueError, TypeError):
        return ranked
    return ranked


def within_budget(rows: list[dict], matched: list[str], unmatched: list[str], top: int, base: int = 2_000, extra: int = 250) -> dict:
    """A brief of at most base + extra a result characters: reasons get shorter from the end, then term lists, then results go."""
    limit = base + extra * max(0, top - 8)
    rows = [dict(r) for r in rows]
    out = lambda: {"matched": matched, "unmatched": unmatched, "results": rows}
    size = lambda: len(json.dumps(out(), ensure_ascii=False, separators=(",", ":")))
    for shorten in (lambda r: re.sub(r"\+[^ ]*", "", r), lambda r: r.split(":")[0]):
        for row in reversed(rows):
            if size() <= limit:
                return out()
            row["reason"] = shorten(row["reason"])
    for name in ("unmatched", "matched"):
        terms = unmatched if name == "unmatched" else matched
        for n in range(len(terms) - 1, -1, -1):
            if size() <= limit:
                break
            bounded = [*terms[:n], f"+{len(terms) - n} more"]
            matched, unmatched = (matched, bounded) if name == "unmatched" else (bounded, unmatched)
    while rows and size() > limit:
        rows.pop()
    return out()
