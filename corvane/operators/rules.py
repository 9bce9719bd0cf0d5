"""Flat front matter, links and citations, boundary and data-loss checks on lines and payloads, and body preservation.

A bundle is a table docs(path, text). Front matter is a leading block between lines of three dashes with flat `key: value` rows and lists.
The profiles of validation are in `validation`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Names of credentials, values that stand for none, what a text of the inside says.
CREDENTIALS = ["api_key", "apikey", "api-key", "token", "secret", "password"]
PLACEHOLDERS = ["null", "none", "undefined", "todo", "tbd", "changeme", "change-me", "placeholder", "redacted", "example", "dummy", "string", "number", "boolean", "unknown", "any"]
INTERNAL_PATHS = ["tools/agents/", "docs/plans/", ".codex/skills/"]
PROPRIETARY = ["prompt text", "scoring formula", "calibration value", "proprietary threshold"]

# What a payload must not hold, by family.
PAYLOAD_NAMES = ["api_key", "token", "secret", "password"]
TOKEN_PREFIXES = ["sk-", "sk_", "xoxb-", "xoxp-", "glpat-", "github_pat_"]


# --- front matter ----------------------------------------------------------------------------------------------------


def split_front_matter(docs: DataFrame) -> DataFrame:
    """Adds header (null without one), body and fields (map of flat keys)."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("__f", tx.front_matter(raw))
    header, has = F.coalesce("__f.header", F.lit("")), F.col("__f.header").isNotNull()
    rows = F.filter(F.split(header, "\n"), lambda r: r.rlike("^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = F.transform(rows, lambda r: F.struct(F.regexp_extract(r, "^([^:]+):", 1).alias("k"), F.regexp_replace(F.regexp_extract(r, r"^[^:]+:\s*(.*)$", 1), "^[\"']|[\"']$", "").alias("v")))
    # pairs and keys are columns of their own: within the lambda below they would be read from the rows again for each of them
    docs = docs.withColumn("__pairs", pairs).withColumn("__keys", F.transform("__pairs", lambda p: p["k"]))
    clean = F.size(F.array_distinct("__keys")) == F.size("__keys")
    first = F.filter("__pairs", lambda p, i: F.array_position("__keys", p["k"]) == i + 1)
    columns = {"header": F.when(has, header), "body": F.when(has, F.col("__f.body")).otherwise(raw), "fields": F.map_from_entries(first), "unique_keys": clean}
    return docs.withColumns(columns).drop("__f", "__pairs", "__keys")


def field(name: str) -> Column:
    """A front-matter value, null without it."""
    return F.try_element_at("fields", F.lit(name))


# --- links, citations, lifecycle -----------------------------------------------------------------------------------


def links(docs: DataFrame) -> DataFrame:
    """(path, target): relative Markdown links, resolved against the document's folder."""
    raw = docs.select("path", F.explode(tx.markdown_links(F.coalesce("text", F.lit("")))).alias("t"))
    clean = F.regexp_replace(F.regexp_replace("t", "[#?].*$", ""), r"\s.*$", "")
    return raw.select("path", tx.normalize_path(F.concat_ws("/", tx.directory(F.col("path")), clean)).alias("target")).where("target is not null and target <> ''").distinct()


def broken_links(docs: DataFrame) -> DataFrame:
    """(path, target) of links to documents that aren't there."""
    return links(docs).join(docs.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")


def orphans(docs: DataFrame) -> DataFrame:
    """(path) of documents without a link from another, but for the first by path."""
    inbound = links(docs).where("path <> target").select(F.col("target").alias("path")).distinct()
    root = docs.agg(F.min("path").alias("root"))
    return docs.select("path").join(inbound, "path", "left_anti").crossJoin(F.broadcast(root)).where("path <> root").select("path")


def bad_citations(docs: DataFrame) -> DataFrame:
    """(path, cited, line, code): citations of missing files, or of lines beyond the end."""
    cited = docs.select("path", F.explode(F.array_distinct(tx.citations(F.coalesce("text", F.lit(""))))).alias("c")).select("path", F.regexp_extract("c", "^(.*):", 1).alias("cited"), F.regexp_extract("c", ":([0-9]+)$", 1).cast("int").alias("line"))
    sizes = docs.select(F.col("path").alias("cited"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    both = cited.join(sizes, "cited", "left")
    return both.select("path", "cited", "line", F.when(F.col("lines").isNull(), "citation-missing-file").when((F.col("line") > F.col("lines")) | (F.col("line") == 0), "citation-beyond-end").alias("code")).where("code is not null")


def body_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): whether bodies without their headers are the same byte for byte in two bundles."""
    digest = lambda frame, name: split_front_matter(frame).select("path", F.sha2(F.encode("body", "UTF-8"), 256).alias(name))
    both = digest(before, "old").join(digest(after, "new"), "path", "full_outer")
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "preserved").otherwise("changed").alias("state"))


# --- lines: boundary and data loss -----------------------------------------------------------------------------------


def _octets() -> str:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return rf"(?<![0-9.])(?:0*10\.{part}|0*192\.0*168|0*172\.0*(?:1[6-9]|2[0-9]|3[01]))\.{part}\.{part}(?![0-9.])"


#: Text in which every quote that opens is closed; a backslash takes the next character within quotes only.
_BALANCED = r"""^(?:[^'"`]|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`)*+$"""
_NO_VALUE = r"(?i)^(?:" + "|".join(PLACEHOLDERS) + r"|your[-_].*|replace[-_].*|[x*-]*)$"


def _assigns(line: Column, start: Column, size: Column) -> Column:
    """Whether the credential's name at a place (from 0) of a line is given a value that is no placeholder."""
    before, tail = F.substring(line, 1, start), F.substring(line, start + size + 1, F.length(line))
    quote = F.substring(before, -1, F.lit(1))
    named = (start > 0) & quote.isin("'", '"') & F.startswith(tail, quote)
    after = F.regexp_replace(F.when(named, F.substring(tail, 2, F.length(tail))).otherwise(tail), r"(?U)^\s+", "")
    given = after.rlike(r"(?U)^(?::|=(?!\s*[=>]))")
    value = F.regexp_replace(F.substring(after, 2, F.length(after)), r"(?U)^\s+", "")
    quoted = value.rlike("^['\"`]")
    token = F.trim(F.when(quoted, F.regexp_extract(value, "^(['\"`])((?:(?!\\1).)*)", 2)).otherwise(F.regexp_extract(value, r"(?U)^[^\s,;]*", 0)))
    in_pattern = before.rlike(r"^(?:.*[=(\[{,:;!&|?])?\s*/[^/]*$") & F.substring(line, start + 1, F.length(line)).rlike(r"(?<!\\)/")
    runtime = F.lower(value).rlike(r"^(?:process\.env\.|os\.environ\[|std::env::)")
    real = ~token.rlike(r"^\$\{.*\}$") & ~F.regexp_replace(token, r"^[<>\[\]{}]+|[<>\[\]{}]+$", "").rlike(_NO_VALUE) & (F.regexp_count(token, F.lit("[A-Za-z0-9._%+/-]")) >= 6)
    return ~before.rlike("[A-Za-z0-9_$-]$") & ~in_pattern & given & (before.rlike(_BALANCED) | named | runtime) & real


def boundary_codes(line: Column) -> Column:
    """Codes of a line, sorted: credential assignments, paths of the inside, home paths with a user and more, private networks, words of the inside."""
    assigned = F.exists(tx.match_positions(line, "(?i)" + "|".join(CREDENTIALS)), lambda m: _assigns(line, m["start"], F.length(m["value"])))
    low = tx.lower_ascii(line)
    tests = [
        ("credential_assignment", line.rlike("(?i)" + "|".join(CREDENTIALS)) & assigned), ("internal_agent_path", line.rlike("|".join(f"\\Q{x}\\E" for x in INTERNAL_PATHS))), ("private_home_path", line.rlike(r"/home/[^/]+/.|/Users/[^/]+/.|C:\\Users\\[^\\]+\\.")),
        ("private_network_literal", line.rlike(_octets())), ("proprietary_scoring_language", low.rlike("|".join(PROPRIETARY))),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))


def boundary_findings(docs: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """(path, line_no, code, line_sha256) of lines with a code, without those the allowlist (path, code, line_no, line_sha256) has."""
    lines = docs.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    found = lines.select("path", (F.col("n") + 1).alias("line_no"), F.explode(boundary_codes(F.col("line"))).alias("code"), F.sha2(F.encode("line", "UTF-8"), 256).alias("line_sha256"))
    return found if allowlist is None else found.join(allowlist, ["path", "code", "line_no", "line_sha256"], "left_anti")


def dlp_codes(text: Column) -> Column:
    """Families that a payload holds: credentials with a sign after them, home paths, bearers and tokens, private keys."""
    low = tx.lower_ascii(text)
    names, prefixes = "|".join(PAYLOAD_NAMES), "|".join(TOKEN_PREFIXES)
    tests = [
        ("credential_assignment", low.rlike(rf'(?:{names})[=:]|"(?:{names})":')), ("private_home_path", F.contains(text, F.lit("/home/"))),
        ("bearer_or_token", low.rlike(rf"bearer |gh[po]_|(?<![a-z0-9_-])(?=[a-z0-9_-]{{12}})(?:{prefixes})")), ("private_key", F.contains(text, F.lit("-----BEGIN PRIVATE KEY-----"))),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))


def public_excerpt(text: Column, boundary: Column, max_bytes: int) -> Column:
    """The head of a text whose boundary values are all public or safe, and there is one; null else."""
    ok = (F.size(boundary) > 0) & F.forall(boundary, lambda b: b.isin("public", "safe"))
    return F.when(F.coalesce(ok, F.lit(False)), tx.truncate_utf8(F.when(tx.front_matter(text)["header"].isNotNull(), tx.front_matter(text)["body"]).otherwise(text), max_bytes))
