"""Evidence from databases: descriptors of sources and stores, bounded extraction with a pinned snapshot and a deadline, sealed records, nodes for packets."""

from __future__ import annotations

import hashlib
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import dlp_codes
from . import sql_gate
from .header_yaml import HeaderError, parse_header
from .stores import canonical_json

# Keys, engines, modes and outcomes.
SOURCE_KEYS = ["kind", "id", "engine", "database", "credential", "access", "relations", "queries", "snapshot", "max_rows", "max_bytes", "timeout_ms"]
STORE_KEYS = ["kind", "id", "backend", "path", "max_bytes"]
ENGINES, BACKENDS = ["sqlite", "postgresql"], ["file", "sqlite", "postgresql"]
ADMITTED = ["schema-only", "bounded-rows", "truncated"]
OUTCOMES = [*ADMITTED, "cancelled", "timeout", "unavailable", "stale-snapshot", "dlp-rejected"]
#: Defaults and largest values of the limits.
LIMITS = {"max_rows": (100, 10_000), "max_bytes": (65_536, 4 << 20), "timeout_ms": (5_000, 60_000)}


class DescriptorError(ValueError):
    """Why a descriptor isn't taken."""


class Refused(ValueError):
    """Why nothing is extracted at all."""


@dataclass(frozen=True)
class EvidenceSource:
    """A source as its descriptor names it."""

    id: str
    engine: str
    database: str
    relations: tuple[str, ...]
    access: str = "introspection"
    credential: str | None = None
    queries: tuple[str, ...] = ()
    snapshot: str | None = None
    limits: dict[str, int] = field(default_factory=dict)


def _name(value: object) -> bool:
    return isinstance(value, str) and bool(re.fullmatch("[a-z0-9][a-z0-9_-]{0,62}", value))


def _digest(value: object) -> bool:
    return isinstance(value, str) and bool(re.fullmatch("(?:sha256:)?[0-9a-f]{64}", value))


def _fields(text: str, kind: str, keys: list[str]) -> dict:
    try:
        raw = parse_header(text)
    except HeaderError as reason:
        raise DescriptorError(f"malformed: {reason}") from None
    unknown = set(raw) - set(keys)
    if unknown:
        raise DescriptorError(f"unknown key {sorted(unknown)[0]}")
    if raw.get("kind") != kind:
        raise DescriptorError("kind")
    if not _name(raw.get("id")):
        raise DescriptorError("id")
    return raw


def _whole(raw: dict, key: str, default: int, largest: int) -> int:
    value = raw.get(key, default)
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= largest:
        raise DescriptorError(key)
    return value


def parse_source(text: str) -> EvidenceSource:
    """A source's descriptor; raises DescriptorError with the key that is missing or wrong."""
    raw = _fields(text, "evidence-source", SOURCE_KEYS)
    if raw.get("engine") not in ENGINES:
        raise DescriptorError("engine")
    database, credential = raw.get("database"), raw.get("credential")
    on_file = raw["engine"] == "sqlite"
    safe = isinstance(database, str) and bool(database) and not re.match(r"[/\\~]|[A-Za-z]:", database) and ".." not in database.split("/")
    if not (safe if on_file else _name(database)):
        raise DescriptorError("database")
    if on_file == (credential is not None) or credential is not None and not re.fullmatch(r"(?:env|file):[A-Za-z0-9_./-]+", str(credential)):
        raise DescriptorError("credential")
    if raw.get("access", "introspection") not in ("introspection", "bounded-rows"):
        raise DescriptorError("access")
    relations = raw.get("relations")
    if not isinstance(relations, list) or not relations or len(set(map(str, relations))) < len(relations) or not all(isinstance(r, str) and re.fullmatch(r"[a-z_][a-z0-9_]{0,62}\.[a-z_][a-z0-9_]{0,62}", r) for r in relations):
        raise DescriptorError("relations")
    queries = raw.get("queries", [])
    if not isinstance(queries, list) or not all(map(_digest, queries)):
        raise DescriptorError("queries")
    if raw.get("snapshot") is not None and not _digest(raw["snapshot"]):
        raise DescriptorError("snapshot")
    return EvidenceSource(raw["id"], raw["engine"], database, tuple(sorted(relations)), raw.get("access", "introspection"), credential, tuple(queries), raw.get("snapshot"), {k: _whole(raw, k, *v) for k, v in LIMITS.items()})


def parse_store(text: str) -> dict:
    """A state store's descriptor (id, backend, path, max_bytes); only files are stored in."""
    raw = _fields(text, "state-store", STORE_KEYS)
    if raw.get("backend") not in BACKENDS:
        raise DescriptorError("backend")
    if raw["backend"] != "file":
        raise DescriptorError("backend without an adapter")
    path = raw.get("path")
    if not isinstance(path, str) or not path or re.match(r"[/\\~]", path) or ".." in path.split("/"):
        raise DescriptorError("path")
    return {"id": raw["id"], "backend": "file", "path": path, "max_bytes": _whole(raw, "max_bytes", 64 << 20, 1 << 34)}


@dataclass
class Evidence:
    """A sealed record with the rows that were admitted."""

    source_id: str
    outcome: str
    record: str
    result_digest: str
    rows: list[str]
    truncated: bool

    @property
    def digest(self) -> str:
        """SHA-256 of the record."""
        return "sha256:" + hashlib.sha256(self.record.encode()).hexdigest()


def run_bounded(spark: SparkSession, work: Callable, timeout_ms: int, cancel: threading.Event | None = None) -> tuple[object, str | None]:
    """(result, None), or (None, cancelled or timeout): the jobs that `work` starts are ended when the event is set or the time is up."""
    tag, done, why = f"bounded-{time.monotonic_ns()}", threading.Event(), []

    def watch() -> None:
        end = time.monotonic() + timeout_ms / 1000
        while not done.wait(0.02):
            state = "cancelled" if cancel is not None and cancel.is_set() else "timeout" if time.monotonic() >= end else None
            if state:
                why.append(state)
                spark.sparkContext.cancelJobsWithTag(tag)
                return

    if cancel is not None and cancel.is_set():
        return None, "cancelled"
    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        result = work()
        return (None, why[0]) if why else (result, None)
    except Exception:
        if why:
            return None, why[0]
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def collect(spark: SparkSession, source: EvidenceSource, sql: str | None, tables: dict[str, DataFrame], extracted_at: str, snapshot: Callable[[], str | None] = lambda: None, cancel: threading.Event | None = None, dlp: Callable[[str], list[str]] | None = None) -> Evidence:
    """Evidence of a gated statement, or of the relations' columns alone without one.

    Refused: rows where the descriptor admits none, statements that it doesn't list. The snapshot must equal the pinned one before and after. Rows
    with findings of the data-loss check go, and so does all that isn't admitted. `tables` maps schema.relation to a DataFrame.
    """
    gated = None
    if sql is not None:
        if source.access != "bounded-rows":
            raise Refused("rows-not-permitted")
        try:
            gated = sql_gate.gate(sql, list(source.relations))
        except sql_gate.Rejected as reason:
            raise Refused(f"sql: {reason}") from None
        if source.queries and gated.digest not in [q.removeprefix("sha256:") for q in source.queries]:
            raise Refused("query-not-allowlisted")
    outcome, rows, truncated, columns = "schema-only", [], False, []
    seen = snapshot()
    if set(source.relations) - set(tables):
        outcome = "unavailable"
    elif source.snapshot is not None and seen != source.snapshot:
        outcome = "stale-snapshot"
    else:
        columns = [f"{r}.{c}" for r in source.relations for c in tables[r].columns]
        if gated is not None:
            read = lambda: sql_gate.extract(spark, sql, {r: tables[r] for r in source.relations}, source.limits["max_rows"], source.limits["max_bytes"]).orderBy("position").collect()
            found, stopped = run_bounded(spark, read, source.limits["timeout_ms"], cancel)
            if stopped:
                outcome = stopped
            else:
                rows, truncated = [r["row"] for r in found], any(r["truncated"] for r in found)
                outcome = "truncated" if truncated else "bounded-rows"
        if source.snapshot is not None and snapshot() != source.snapshot:
            outcome = "stale-snapshot"
    state = "not-evaluated"
    if outcome in ADMITTED:
        text = "\n".join([*columns, *rows])
        findings = dlp(text) if dlp else spark.range(1).select(dlp_codes(F.lit(text))).first()[0]
        state = "findings" if findings else "passed"
        if findings:
            outcome = "dlp-rejected"
    if outcome not in ADMITTED:
        rows, truncated, columns = [], False, []
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    result = sha("".join(f"{r}\n" for r in rows))
    record = canonical_json({
        "access": source.access, "columns": columns, "credential": source.credential, "database": source.database, "derivation": "schema-only" if gated is None else "query", "dlp": state, "engine": source.engine, "extracted_at": extracted_at, "limits": source.limits, "outcome": outcome,
        "query_digest": gated.digest if gated else None, "relations": list(source.relations), "result_digest": result, "row_count": len(rows), "snapshot": {"state": "attested" if seen else "unavailable", "value": seen}, "source_digest": sha("\n".join(columns)), "source_id": source.id, "truncated": truncated,
    })
    return Evidence(source.id, outcome, record, result, rows, truncated)


def packet_evidence(spark: SparkSession, evidence: Evidence, priority: str = "related") -> tuple[DataFrame, DataFrame]:
    """(node, content) rows of admitted evidence for graphs and packets; four facts are anchors of the content's record."""
    if evidence.outcome not in ADMITTED:
        raise Refused(f"not-admitted: {evidence.outcome}")
    key = f"db:{evidence.source_id}:{evidence.digest.removeprefix('sha256:')[:32]}"
    facts = {"outcome": [evidence.outcome], "truncated": [str(evidence.truncated).lower()], "row_count": [str(len(evidence.rows))], "result_digest": [evidence.result_digest]}
    node = spark.createDataFrame([(key, "external", "database-evidence", f"database:{evidence.source_id}#{evidence.digest}", 50, facts)], "id string, role string, prov_source string, prov_locator string, confidence int, facts map<string,array<string>>")
    content = evidence.record + "\n" + "".join(f"{r}\n" for r in evidence.rows)
    row = spark.createDataFrame([(key, priority, content, 0, 0, [evidence.outcome, evidence.result_digest])], "id string, priority string, content string, authority int, freshness int, anchors array<string>")
    return node, row
