"""Declarative views over nodes: source, filter tree, sort, grouping, projection, and bounds by items and bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M


class ViewError(ValueError):
    """A specification outside its bounds."""


@dataclass(frozen=True)
class ViewSpec:
    """source: ("all",), ("ids", [...]), ("roles", [...]), ("source_contains", s), ("fact", key, value).

    filter: ("all",), ("role", r), ("id_prefix", s), ("source_contains", s), ("locator_contains", s), ("min_confidence", n), ("fact", key, value), ("all_of", [..]), ("any_of", [..]), ("not", f).
    sort: "id", "role", "source", "confidence", ("fact", key). grouping: None, "role", "source", ("fact", key).
    fields: names of node columns or ("fact", key).
    """

    source: tuple = ("all",)
    filter: tuple = ("all",)
    sort: str | tuple = "id"
    grouping: str | tuple | None = None
    fields: list = field(default_factory=lambda: ["id"])
    max_items: int = 128
    max_bytes: int = 1_000_000

    def validate(self) -> None:
        """Checks bounds before any work."""
        clauses = 0

        def walk(f: tuple, depth: int) -> None:
            nonlocal clauses
            clauses += 1
            if depth > M.MAX_FILTER_DEPTH or clauses > M.MAX_FILTER_CLAUSES:
                raise ViewError("the filter is too deep or has too many clauses")
            for inner in f[1] if f[0] in ("all_of", "any_of") else [f[1]] if f[0] == "not" else []:
                walk(inner, depth + 1)

        walk(self.filter, 1)
        if not 1 <= self.max_items <= M.MAX_VIEW_ITEMS or not 1 <= self.max_bytes <= M.MAX_VIEW_BYTES:
            raise ViewError("bounds of items or bytes")
        if self.source[0] == "ids" and not 1 <= len(self.source[1]) <= M.MAX_NODE_IDS or self.source[0] == "roles" and not 1 <= len(self.source[1]) <= M.MAX_SOURCE_ROLES:
            raise ViewError("bounds of the source")
        if not 1 <= len(self.fields) <= M.MAX_VIEW_FIELDS:
            raise ViewError("bounds of fields")


def fact_values(key: str) -> Column:
    """The sorted values of a fact, null without one."""
    return F.try_element_at("facts", F.lit(key))


def has_fact(key: str, value: str) -> Column:
    """Whether a fact has the value."""
    return F.coalesce(F.array_contains(fact_values(key), value), F.lit(False))


def source_matches(source: tuple) -> Column:
    """The predicate of a view's source."""
    kind = source[0]
    if kind == "ids":
        return F.col("id").isin(list(source[1]))
    if kind == "roles":
        return F.col("role").isin(list(source[1]))
    if kind == "source_contains":
        return F.contains(F.col("prov_source"), F.lit(source[1]))
    if kind == "fact":
        return has_fact(source[1], source[2])
    return F.lit(True)


def filter_matches(f: tuple) -> Column:
    """The predicate of a filter tree; all of nothing holds, any of nothing doesn't."""
    kind = f[0]
    if kind == "role":
        return F.col("role") == f[1]
    if kind == "id_prefix":
        return F.startswith(F.col("id"), F.lit(f[1]))
    if kind == "source_contains":
        return F.contains(F.col("prov_source"), F.lit(f[1]))
    if kind == "locator_contains":
        return F.contains(F.col("prov_locator"), F.lit(f[1]))
    if kind == "min_confidence":
        return F.col("confidence") >= f[1]
    if kind == "fact":
        return has_fact(f[1], f[2])
    if kind == "not":
        return ~filter_matches(f[1])
    if kind in ("all_of", "any_of"):
        out = F.lit(kind == "all_of")
        for inner in f[1]:
            out = out & filter_matches(inner) if kind == "all_of" else out | filter_matches(inner)
        return out
    return F.lit(True)


_NAMES = {"id": "node_id", "role": "role", "prov_source": "provenance_source", "prov_locator": "provenance_locator", "confidence": "confidence"}


def field_value(name: str | tuple) -> Column:
    """A projected field as a string."""
    if isinstance(name, tuple):
        return F.coalesce(F.array_join(fact_values(name[1]), ", "), F.lit(""))
    return F.col(name).cast("string")


def sort_keys(sort: str | tuple) -> list[Column]:
    """The order of a view; it ends with the id."""
    first = {"role": [F.asc("role")], "source": [F.asc("prov_source")], "confidence": [F.desc("confidence")]}.get(sort if isinstance(sort, str) else "", [])
    if isinstance(sort, tuple):
        first = [F.asc_nulls_first(F.get(fact_values(sort[1]), F.lit(0)))]
    return [*first, F.asc("id")]


def group_key(grouping: str | tuple | None) -> Column:
    """The group of a node, '' without a fact, null without grouping."""
    if grouping is None:
        return F.lit(None).cast("string")
    if isinstance(grouping, tuple):
        return F.coalesce(F.get(fact_values(grouping[1]), F.lit(0)), F.lit(""))
    return F.col({"role": "role", "source": "prov_source"}[grouping])


def _record(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), F.octet_length(value).cast("string"), F.lit(":"), value, F.lit("\n"))


def canonical_item(group: Column, fields: list) -> Column:
    """The canonical record of an item, by which bytes are counted."""
    parts = [_record("i", F.col("id")), F.coalesce(_record("g", group), F.lit("g:-\n")), _record("s", F.col("prov_source")), _record("l", F.col("prov_locator"))]
    for name in fields:
        parts += [_record("n", F.lit(name[1] if isinstance(name, tuple) else _NAMES[name])), _record("v", field_value(name))]
    return F.concat(*parts)


def compile_view(nodes: DataFrame, spec: ViewSpec) -> DataFrame:
    """(position, id, group, fields, bytes, selected_bytes, truncated): items in order up to the first that exceeds a bound.

    Only max_items + 1 rows can matter, so a top-k cut comes before the running total.
    """
    spec.validate()
    found = nodes.where(source_matches(spec.source) & filter_matches(spec.filter))
    best = found.orderBy(*sort_keys(spec.sort)).limit(spec.max_items + 1)
    group = group_key(spec.grouping)
    order = Window.orderBy(*sort_keys(spec.sort))
    rows = best.withColumns({"position": F.row_number().over(order), "group": group, "bytes": F.octet_length(canonical_item(group, spec.fields)).cast("long")})
    rows = rows.withColumn("selected_bytes", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = (F.col("position") <= spec.max_items) & (F.col("selected_bytes") <= spec.max_bytes)
    rows = rows.withColumn("truncated", F.max(~fits).over(Window.partitionBy()))
    values = F.array(*[field_value(f) for f in spec.fields])
    return rows.where(fits).select("position", "id", "group", values.alias("fields"), "bytes", "selected_bytes", "truncated")


def groups(view: DataFrame) -> DataFrame:
    """(group, ids) of a compiled view, ids in the view's order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "id")))
    return view.groupBy(F.coalesce("group", F.lit("")).alias("group")).agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))
