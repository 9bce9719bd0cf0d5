"""Rules on the optional families of headers: sources, usage window, generated, verified, status, staleness, attested computations.

Headers are read once into JSON; every rule is a predicate on a VARIANT, and all are checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.header_yaml import with_json
from .rules import split_front_matter

# Statuses of the family.
STATUSES = ["draft", "stable", "active", "deprecated"]


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1), F.lit("VOID"))


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _there(value: Column, key: str) -> Column:
    return _get(value, f"$.{key}", "variant").isNotNull()


def _is(value: Column, key: str, kind: str) -> Column:
    return _kind(_get(value, f"$.{key}", "variant")) == kind


def _text(value: Column, key: str) -> Column:
    """Whether a key holds a string that isn't blank."""
    return F.coalesce(_is(value, key, "STRING") & (F.trim(_get(value, f"$.{key}", "string")) != ""), F.lit(False))


def _items(value: Column, key: str) -> Column:
    return F.coalesce(_get(value, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def _any(items: Column, broken) -> Column:
    return F.exists(items, broken)


def family_rules(v: Column) -> list[tuple[str, Column]]:
    """The rules as (code, predicate) on a header as VARIANT."""
    mapping = lambda x: _kind(x) == "OBJECT"
    events = F.when(_is(v, "verified", "OBJECT"), F.array(_get(v, "$.verified", "variant"))).otherwise(F.filter(_items(v, "verified"), mapping))
    attested = F.coalesce(_get(v, "$.type", "string") == "Attested Computation", F.lit(False))
    executor = _get(v, "$.executor", "variant")
    return [
        ("sources-not-sequence", _there(v, "sources") & ~_is(v, "sources", "ARRAY")), ("source-entry-not-mapping", _any(_items(v, "sources"), lambda e: ~mapping(e))), ("source-entry-resource", _any(_items(v, "sources"), lambda e: mapping(e) & ~_text(e, "resource"))),
        ("usage-window-not-mapping", _there(v, "usage_window") & ~_is(v, "usage_window", "OBJECT")), ("usage-window-from", _is(v, "usage_window", "OBJECT") & ~_text(v, "usage_window.from")), ("usage-window-to", _is(v, "usage_window", "OBJECT") & ~_text(v, "usage_window.to")),
        ("generated-not-mapping", _there(v, "generated") & ~_is(v, "generated", "OBJECT")), ("generated-by", _is(v, "generated", "OBJECT") & ~_text(v, "generated.by")), ("generated-at", _is(v, "generated", "OBJECT") & _there(v, "generated.at") & ~_text(v, "generated.at")),
        ("verified-shape", _there(v, "verified") & ~_is(v, "verified", "OBJECT") & ~_is(v, "verified", "ARRAY")), ("verified-event-not-mapping", _any(_items(v, "verified"), lambda e: ~mapping(e))), ("verified-by", _any(events, lambda e: ~_text(e, "by"))), ("verified-at", _any(events, lambda e: ~_text(e, "at"))),
        ("status-value", _there(v, "status") & ~F.coalesce(_is(v, "status", "STRING") & _get(v, "$.status", "string").isin(STATUSES), F.lit(False))), ("stale-after-shape", _there(v, "stale_after") & ~(_is(v, "stale_after", "STRING") & tx.is_iso_date(_get(v, "$.stale_after", "string")))),
        ("ac-runtime", attested & ~_text(v, "runtime")), ("ac-parameters", attested & _there(v, "parameters") & ~(_is(v, "parameters", "ARRAY") & F.forall(_items(v, "parameters"), lambda e: mapping(e) & _text(e, "name") & _text(e, "type")))),
        ("ac-computation", attested & _there(v, "computation") & ~_text(v, "computation")), ("ac-executor", attested & executor.isNotNull() & ~(mapping(executor) & _text(v, "executor.resource") & (~_there(v, "executor.receipt") | _is(v, "executor.receipt", "ARRAY")))),
        ("ac-attester", attested & _there(v, "attester") & ~(_is(v, "attester", "OBJECT") & _text(v, "attester.resource"))),
    ]


def family_diagnostics(docs: DataFrame) -> DataFrame:
    """(profile, path, code) of documents whose header can be read."""
    rows = split_front_matter(docs).where("header is not null")
    read = with_json(rows.select("path", "header"), "header", "json").where("json is not null").select("path", F.parse_json("json").alias("v"))
    codes = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in family_rules(F.col("v"))]))
    return read.select(F.lit("families").alias("profile"), "path", F.explode(codes).alias("code"))
