"""The log of answered questions: append with a bound, gaps, stale rows, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M


class StoreFull(RuntimeError):
    """The log holds as many records as it may."""


def append(log: DataFrame, record: DataFrame, limit: int = M.MAX_EVIDENCE_RECORDS) -> DataFrame:
    """The log with the records in place of those with the same request and roots, ordered; refuses beyond the limit instead of dropping."""
    kept = log.join(record.select("request", "roots"), ["request", "roots"], "left_anti").unionByName(record)
    if kept.limit(limit + 1).count() > limit:
        raise StoreFull("evidence_store_full")
    return kept.orderBy("request", "roots")


def gap_summary(log: DataFrame, rankings: DataFrame, documents: DataFrame, classified: DataFrame, stale: DataFrame) -> DataFrame:
    """(kind, item, n): unanswered terms, retrieved, path-only, never-retrieved, unclassified and stale documents.

    log(request, unmatched), rankings(request, locator, match_reason), documents(locator), classified(locator), stale(locator, code).
    """
    unanswered = log.select(F.explode("unmatched").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    retrieved = rankings.groupBy(F.col("locator").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    only_path = rankings.groupBy(F.col("locator").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("match_reason").isin("exact:path", "partial:path")).alias("only")).where("only").drop("only")
    never = documents.join(rankings.select("locator"), "locator", "left_anti").select(F.col("locator").alias("item"), F.lit(0).cast("long").alias("n"))
    unclassified = documents.join(classified.select("locator"), "locator", "left_anti").select(F.col("locator").alias("item"), F.lit(0).cast("long").alias("n"))
    old = stale.groupBy(F.col("locator").alias("item")).agg(F.count_distinct("code").alias("n"))
    missing = rankings.select("locator").distinct().join(documents, "locator", "left_anti").select(F.col("locator").alias("item"), F.lit(0).cast("long").alias("n"))
    parts = {"unanswered-term": unanswered, "retrieved": retrieved, "path-only": only_path, "never-retrieved": never, "unclassified": unclassified, "stale": old, "missing-locator": missing}
    out = None
    for kind, frame in parts.items():
        frame = frame.select(F.lit(kind).alias("kind"), "item", "n")
        out = frame if out is None else out.unionByName(frame)
    return out


def proposals(gaps: DataFrame) -> DataFrame:
    """(action, item): what would close each gap."""
    actions = {"unanswered-term": "add-evidence", "path-only": "add-metadata", "never-retrieved": "review-relevance", "unclassified": "classify", "stale": "refresh", "missing-locator": "repair-locator"}
    table = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])
    return gaps.withColumn("action", F.try_element_at(table, F.col("kind"))).where("action is not null").select("action", "item")


def recall(results: DataFrame) -> DataFrame:
    """(class, questions, top1, top5, misses, median_ms, worst_ms) of rows (class, rank or null, ms)."""
    return results.groupBy(F.coalesce("class", F.lit("unlabelled")).alias("class")).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("rank") <= 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"), F.count_if(F.col("rank").isNull()).alias("misses"), F.median("ms").alias("median_ms"), F.max("ms").alias("worst_ms")
    )


# The first line of a stored log, fields of a ranking, bounds.
CODEC_VERSION = "evidence-log 1"
RANKING_FIELDS = ["rank", "bundle", "locator", "match_reason", "exact", "partial", "active", "canonical", "public_safe", "confidence", "freshness"]
MAX_LOG_BYTES, MAX_REQUEST_BYTES, MAX_ROOTS, MAX_RANKINGS = 64 * 1024, 4 * 1024, 16, 32
_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r"}


class CodecError(ValueError):
    """A log that can't be written or read."""


def _escaped(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def _plain(text: str) -> str:
    back, out, at = {v[1]: k for k, v in _ESCAPES.items()}, [], 0
    while at < len(text):
        if text[at] == "\\":
            if text[at + 1 : at + 2] not in back:
                raise CodecError("an unknown escape")
            out.append(back[text[at + 1]])
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def encode_log(records: list[dict]) -> bytes:
    """A log as lines of tab-separated fields under a version; records: request, roots, outcome, matched, unmatched, rankings (dicts of RANKING_FIELDS)."""
    if len(records) > M.MAX_EVIDENCE_RECORDS:
        raise CodecError("full")
    lines = [CODEC_VERSION]
    for r in records:
        if len(r["request"].encode()) > MAX_REQUEST_BYTES or len(r["roots"]) > MAX_ROOTS or len(r["rankings"]) > MAX_RANKINGS:
            raise CodecError("oversized")
        lines += ["---", f"request\t{_escaped(r['request'])}", *(f"root\t{_escaped(x)}" for x in r["roots"]), f"outcome\t{_escaped(r['outcome'])}", *(f"matched\t{_escaped(x)}" for x in r["matched"]), *(f"unmatched\t{_escaped(x)}" for x in r["unmatched"])]
        lines += ["rank\t" + "\t".join(_escaped(str(x[f])) for f in RANKING_FIELDS) for x in r["rankings"]]
    data = ("\n".join(lines) + "\n").encode()
    if len(data) > MAX_LOG_BYTES:
        raise CodecError("oversized")
    return data


def decode_log(data: bytes) -> list[dict]:
    """The records of a log; raises CodecError for another version, unknown or doubled fields, and records without a request or an outcome."""
    if len(data) > MAX_LOG_BYTES:
        raise CodecError("oversized")
    lines = data.decode().split("\n")
    if lines[0] != CODEC_VERSION or lines[-1]:
        raise CodecError("an unknown version, or no end")
    records: list[dict] = []
    for line in lines[1:-1]:
        key, *values = line.split("\t")
        if key == "---" and not values:
            records.append({"roots": [], "matched": [], "unmatched": [], "rankings": []})
            continue
        if not records:
            raise CodecError("a field before a record")
        values, record = [_plain(v) for v in values], records[-1]
        if key in ("request", "outcome") and len(values) == 1 and key not in record:
            record[key] = values[0]
        elif key in ("root", "matched", "unmatched") and len(values) == 1:
            record["roots" if key == "root" else key].append(values[0])
        elif key == "rank" and len(values) == len(RANKING_FIELDS):
            texts = {"bundle", "locator", "match_reason", "freshness"}
            try:
                record["rankings"].append({f: v if f in texts else int(v) for f, v in zip(RANKING_FIELDS, values, strict=True)})
            except ValueError:
                raise CodecError("a number") from None
        else:
            raise CodecError(f"a wrong field {key}")
    if any("request" not in r or "outcome" not in r for r in records) or len(records) > M.MAX_EVIDENCE_RECORDS:
        raise CodecError("an incomplete record")
    return records


# Controls of experiments with their least and largest values.
CONTROLS = {"max-sources": (1, 32), "dependency-depth": (0, 4), "response-sources": (1, 32), "excerpt-bytes": (0, 900)}


def experimental_controls(given: dict[str, str]) -> dict[str, int]:
    """Controls as numbers; raises ValueError for unknown ones and values out of their range."""
    out = {}
    for key, value in given.items():
        if key not in CONTROLS or not value.isascii() or not value.isdigit() or not CONTROLS[key][0] <= int(value) <= CONTROLS[key][1]:
            raise ValueError(f"{key} {value}")
        out[key] = int(value)
    return out


def reevaluate(recorded: DataFrame, requests: list[str], answer) -> DataFrame:
    """(request, bundle, locator, change): recorded rankings against those of today; `answer` ranks one request and gives bundle, locator, rank, match_reason.

    A log has 32 requests at most.
    """
    from .incremental import ranking_differences

    now = None
    for request in requests[: M.MAX_EVIDENCE_RECORDS]:
        rows = answer(request).withColumn("request", F.lit(request))
        now = rows if now is None else now.unionByName(rows)
    return ranking_differences(recorded, now, ["request", "bundle", "locator"], ["rank", "match_reason"])
