"""Structural parse of files: source types, relations from facts and diagrams, states of nodes, edges with targets that may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut

# Source types by extension.
SOURCE_TYPES = {
    "text": ["txt", "text", "rst"], "code": ["rs", "java", "js", "jsx", "ts", "tsx", "go", "cs", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "py", "rb", "sh", "bash", "zsh"],
    "markdown": ["md", "markdown"], "mermaid": ["mmd", "mermaid"], "metadata": ["yaml", "yml", "toml", "ini", "cfg"],
}

# Keys of facts that are relations, by the kind of edge.
RELATION_KEYS = {
    "ownership": "ownership", "supersedes": "supersedes", "predecessor": "predecessor", "dependency": "dependency", "impact": "impact", "requirement": "requirement", "design": "design", "implementation": "implementation",
    "validation": "validation", "domain": "domain", "architecture": "architecture", "business_flow": "business-flow", "generated_from": "generated-from", "source_link": "source-link",
}

# States, the first of each being the default.
LIFECYCLE = ["current", "superseded", "draft", "archive", "rejected"]
AUTHORITY = ["unknown", "canonical", "approved", "supporting"]
GENERATED = ["source", "generated", "preextracted"]
#: Statuses of other tools as ours.
STATUS = {"draft": "draft", "active": "stable", "stable": "stable", "deprecated": "deprecated"}

MAX_BYTES = 1 << 20


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def source_type(path: Column) -> Column:
    """The source type by what follows the last dot, case aside; null for other files."""
    extension = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.try_element_at(_map({e: t for t, names in SOURCE_TYPES.items() for e in names}), extension)


def relation_kind(key: Column) -> Column:
    """The kind of edge that a fact's key stands for, null for other facts."""
    return F.try_element_at(_map(RELATION_KEYS), key)


def mapped_status(status: Column) -> Column:
    """Another tool's status as ours, null for unknown ones."""
    return F.try_element_at(_map(STATUS), status)


# Parts of paths that mark a boundary.
BOUNDARY_PARTS = [".github/", "auth", "ci/", "credential", "deploy", "infra/", "policy", "secret", "security", "workflow", "cargo.toml"]


def boundary_marker(path: Column, text: Column) -> Column:
    """Whether a file lies at a boundary: by its path, case of A-Z aside, or since it holds a private key."""
    low = tx.lower_ascii(path)
    return F.contains(text, F.lit("BEGIN PRIVATE KEY")) | low.rlike("|".join(f"\\Q{x}\\E" for x in BOUNDARY_PARTS))


def _trimmed_lines(docs: DataFrame, kind: str) -> DataFrame:
    lines = docs.where(source_type(F.col("path")) == kind).select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "raw"))
    return lines.select("path", (F.col("n") + 1).alias("line"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("row"))


def mermaid_edges(docs: DataFrame) -> DataFrame:
    """(path, src, dst, line): rows `a --> b` of diagram files with plain ids on both sides."""
    arrow = r"^([A-Za-z0-9_-]+?)\s*-->\s*([A-Za-z0-9_-]+)$"
    found = _trimmed_lines(docs, "mermaid").where(F.col("row").rlike(arrow))
    return found.select("path", F.regexp_extract("row", arrow, 1).alias("src"), F.regexp_extract("row", arrow, 2).alias("dst"), "line")


def bare_metadata(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, key, value, line), (path, line, error)): rows `key = value` or `key: value` of settings files; a file with a row that is neither gives no fact.

    Blank rows, remarks, separators and sections are passed over.
    """
    rows = _trimmed_lines(docs, "metadata").where(~F.col("row").rlike(r"^(?:$|#|\[|---$)"))
    sign = F.when(F.contains("row", F.lit("=")), F.lit("=")).when(F.contains("row", F.lit(":")), F.lit(":"))
    at = F.instr("row", sign)
    key, value = F.trim(F.substring("row", 1, at - 1)), F.trim(F.substring("row", at + 1, F.length("row")))
    error = F.when(sign.isNull(), "not-key-value").when(~key.rlike("^[A-Za-z0-9_.-]+$") | (value == "") | value.rlike(r"^[\[{|>]"), "unsupported-scalar").when(value.rlike("^(?:\"[^\"]*|'[^']*)$"), "open-quote")
    marked = cut(rows.select("path", "line", key.alias("key"), F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2").alias("value"), error.alias("error")))
    wrong = marked.where("error is not null").select("path", "line", "error")
    return marked.join(wrong.select("path").distinct(), "path", "left_anti").select("path", "key", "value", "line"), wrong


def fact_locator(path: Column, text: Column, key: Column, value: Column) -> Column:
    """path:line of the first line that holds key and value, else path:inferred:key."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.when(F.contains(line, key) & F.contains(line, value), i + 1))
    first = F.get(F.array_compact(lines), F.lit(0))
    return F.concat_ws(":", path, F.coalesce(first.cast("string"), F.concat(F.lit("inferred:"), key)))


def node_states(facts: DataFrame) -> DataFrame:
    """(path, lifecycle, authority, generated_status, error) from rows (path, key, value): the least value of each key counts; a value outside the list is an error."""
    of = lambda key: F.min(F.when(F.col("key") == key, F.col("value")))
    made = F.coalesce(of("generated_status"), F.max(F.when((F.col("key") == "type") & (F.col("value") == "generated"), F.lit("generated"))))
    rows = facts.groupBy("path").agg(of("lifecycle").alias("l"), of("authority").alias("a"), made.alias("g"))
    error = F.lit(None).cast("string")
    for column, names, label in (("g", GENERATED, "generated_status"), ("a", AUTHORITY, "authority"), ("l", LIFECYCLE, "lifecycle")):
        error = F.when(F.col(column).isNotNull() & ~F.col(column).isin(names), label).otherwise(error)
    return rows.select("path", F.coalesce("l", F.lit(LIFECYCLE[0])).alias("lifecycle"), F.coalesce("a", F.lit(AUTHORITY[0])).alias("authority"), F.coalesce("g", F.lit(GENERATED[0])).alias("generated_status"), error.alias("error"))


def parse(docs: DataFrame) -> DataFrame:
    """(path, source_type, status): accepted files, or rejected ones by reason: unsafe-path, unsupported-type, oversized, invalid-text."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    unsafe = path.isNull() | (path == "") | path.rlike(r"^[/\\]|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)|\x00")
    status = F.when(unsafe, "unsafe-path").when(source_type(path).isNull(), "unsupported-type").when(F.octet_length(text) > MAX_BYTES, "oversized").when(F.contains(text, F.lit("\x00")), "invalid-text").otherwise("accepted")
    return docs.select("path", source_type(path).alias("source_type"), status.alias("status"))


def structural_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(id, kind, src, dst, locator, certainty) from facts (path, key, value) that are relations; a target that no file has gets an id of its own and is missing."""
    relations = facts.withColumn("kind", relation_kind(F.col("key"))).where("kind is not null").select("path", "kind", "value").distinct()
    known = files.select(F.col("path").alias("value"), F.lit(True).alias("there"))
    joined = relations.join(known, "value", "left")
    missing = F.sha2(F.encode(F.concat(F.lit("missing\n"), "value"), "UTF-8"), 256)
    target = F.when(F.col("there"), F.col("value")).otherwise(missing)
    return joined.select(F.concat_ws("|", "path", "kind", "value").alias("id"), "kind", F.col("path").alias("src"), target.alias("dst"), F.col("path").alias("locator"), F.when(F.col("there"), "known").otherwise("missing-target").alias("certainty"))


def content_time(header: Column) -> Column:
    """When the content changed, of a header as VARIANT: generated.at, else timestamp; null without a string that isn't blank."""
    text = lambda path: F.try_variant_get(header, path, "string")
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(header, path, "variant")) == "STRING", F.lit(False))
    filled = lambda path: F.when(is_text(path) & (F.trim(text(path)) != ""), text(path))
    return F.coalesce(filled("$.generated.at"), filled("$.timestamp"))


def provenance_resources(header: Column, body: Column) -> Column:
    """Where content comes from: the resources of a header's sources; without a list of sources, the link targets after the citations' heading."""
    sources = F.try_variant_get(header, "$.sources", "array<variant>")
    resource = lambda s: F.try_variant_get(s, "$.resource", "variant")
    good = F.filter(sources, lambda s: F.coalesce((F.schema_of_variant(resource(s)) == "STRING") & (F.trim(F.try_variant_get(s, "$.resource", "string")) != ""), F.lit(False)))
    at = F.instr(body, "# Citations")
    cited = F.filter(F.regexp_extract_all(F.substring(body, F.greatest(at, F.lit(1)), F.length(body)), F.lit(r"\]\(([^)]*)"), F.lit(1)), lambda t: F.trim(t) != "")
    none = F.array().cast("array<string>")
    return F.when(sources.isNotNull(), F.transform(good, lambda s: F.try_variant_get(s, "$.resource", "string"))).when(at > 0, cited).otherwise(none)
