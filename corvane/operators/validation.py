"""Validation of a bundle docs(path, text) under three profiles, with or without a policy.

Headers are read once; what the rules need of bodies is computed before, so bodies never leave the JVM. A rule is a predicate, or an array with an
entry for each finding; all rules of a profile are checked in one pass. Diagnostics are (profile, path, code, detail); detail tells findings of one
code in one document apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from ..sources.header_yaml import with_json
from ..sources.policy import Policy
from .header_families import family_rules

PROFILES = ["v0.1", "v0.2", "strict"]

# Default statuses, values that cross the public boundary, extensions of cited files, kinds of helper packets.
STATUSES = ["draft", "active", "deprecated"]
PUBLIC = ["public", "public-candidate", "external", "publishable"]
CITED = ["md", "py", "ts", "tsx", "js", "mjs", "rs", "c", "h", "yaml", "yml", "json", "sh"]
HELPERS = ["research-assistant", "ingestion-librarian", "synthesis-librarian", "integrity-librarian"]

def _none() -> Column:
    return F.lit(None).cast("string")


def _texts(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def split_documents(docs: DataFrame) -> DataFrame:
    """(path, kind, text, header, opened, body): kind is index, log or concept; header is null without a closed block; opened: a block begins."""
    text = F.coalesce("text", F.lit(""))
    name = tx.file_name(F.col("path"))
    kind = F.when(name == "index.md", "index").when(name == "log.md", "log").otherwise("concept")
    return docs.select("path", kind.alias("kind"), text.alias("text"), tx.front_matter(text).alias("f")).select("path", "kind", "text", "f.header", "f.opened", "f.body")


def prepared(docs: DataFrame, strict: bool = True, cited: bool = False) -> DataFrame:
    """What the rules need of each document, cut off: path, kind, opened, json (the header), body of pages of links and of dates; with `strict` cites, links
    and targets, with `cited` too the cited web targets.

    Texts are read once and headers go through Python once, however many profiles and rules follow.
    """
    rows, body = split_documents(docs), F.col("body")
    kept = [F.when(F.col("kind") != "concept", body).alias("body")]
    if strict:
        kept += [(F.contains(body, F.lit("# Citations")) | F.contains(body, F.lit("Citations:")) | F.contains(body, F.lit("[1]"))).alias("cites"), F.contains(body, F.lit("](")).alias("links")]
        kept.append(_targets(body).alias("targets"))
        kept.append((cited_links(body) if cited else F.array().cast("array<string>")).alias("cited"))
    return cut(with_json(rows.select("path", "kind", "header", "opened", *kept), "header", "json").drop("header"))


def _targets(body: Column) -> Column:
    """Targets of links without their anchors."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"\]\(([^) \t\r\n]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "#.*$", ""))


def _read(rows: DataFrame) -> DataFrame:
    """Adds v, the header as VARIANT (empty without a block, null if it can't be read), and bad, whether a block is there that can't be read."""
    read = (rows if "json" in rows.columns else with_json(rows, "header", "json")).withColumn("json", F.when(F.col("opened"), F.col("json")).otherwise("{}"))
    return read.withColumns({"v": F.parse_json("json"), "bad": F.col("opened") & F.col("json").isNull(), "keys": F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))})


def _kind(key: str) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")), "^([A-Z]+)", 1), F.lit(""))


def _string(key: str) -> Column:
    """A header value if it is a string."""
    return F.when(_kind(key) == "STRING", F.try_variant_get("v", f"$.{key}", "string"))


def _filled(key: str) -> Column:
    return F.coalesce(F.trim(_string(key)) != "", F.lit(False))


def floor_code() -> Column:
    """The code of a header that can't be read or has no type that is a string and not blank, null if all is well."""
    there = F.array_contains("keys", F.lit("type"))
    return F.when(F.col("bad"), "malformed-frontmatter").when(~there, "missing-type").when(_kind("type") != "STRING", "non-string-type").when(~_filled("type"), "blank-type")


def _findings(rows: DataFrame, profile: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each finding: a rule gives a boolean, or an array of details."""
    parts = []
    kinds = rows.select(*[found.alias(f"r{i}") for i, (_, found) in enumerate(rules)]).schema.fields
    for (code, found), kind in zip(rules, kinds, strict=True):
        if kind.dataType.typeName() == "array":
            parts.append(F.transform(F.coalesce(found, F.array().cast("array<string>")), _struct_of(code)))
        else:
            parts.append(F.when(F.coalesce(found, F.lit(False)), F.array(_struct_of(code)(_none()))).otherwise(F.array().cast("array<struct<code:string,detail:string>>")))
    return rows.select(F.lit(profile).alias("profile"), "path", F.explode(F.flatten(F.array(*parts))).alias("f")).select("profile", "path", "f.code", "f.detail")


def _struct_of(code: str):
    return lambda d: F.struct(F.lit(code).alias("code"), d.cast("string").alias("detail"))


# --- which documents belong ------------------------------------------------------------------------------------------


def under_root(path: Column, roots) -> Column:
    """Whether a path lies at or below one of the roots, by whole components; `.` holds all."""
    hit = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        hit = hit | (F.lit(True) if root == "." else (path == root) | F.startswith(path, F.lit(f"{root}/")))
    return hit


def participates(path: Column, policy: Policy | None) -> Column:
    """Whether a document is classified or lies under a root, and isn't excluded; all do without coverage."""
    if policy is None or not policy.has("document_coverage"):
        return F.lit(True)
    named = path.isin(policy.classified) if policy.classified else F.lit(False)
    left_out = path.isin(policy.excluded) if policy.excluded else F.lit(False)
    return ~left_out & (named | under_root(path, policy.get("document_coverage", "roots")))


def portable(path: Column, policy: Policy | None) -> Column:
    """Whether a document takes part in the portable profiles: the native ones, if the policy names any."""
    native = policy.get("document_coverage", "native_bundle") if policy else ()
    return path.isin(list(native)) if native else participates(path, policy)


# --- pages of links and of dates -----------------------------------------------------------------------------------


def _lines(rows: DataFrame, kind: str) -> DataFrame:
    """(path, n, line, heading) of the lines that aren't blank; heading is null for others. Lines of one page stand in one window: a page is one file."""
    lines = rows.where(F.col("kind") == kind).select("path", F.posexplode(F.split("body", "\n")).alias("n", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    heading = F.trim(F.regexp_extract("line", r"^#{1,6} (.*)$", 1))
    return lines.where("line <> ''").select("path", "n", "line", F.when(heading != "", heading).alias("heading"))


def index_findings(rows: DataFrame, profile: str) -> DataFrame:
    """Index pages: links stand under headings, each heading has a link, and there are both."""
    order = Window.partitionBy("path").orderBy("n")
    link = F.col("heading").isNull() & F.col("line").rlike(r"^[^\[]*\[[^\]]*\]\([^)]*[^)\s][^)]*\)")
    lines = _lines(rows, "index").withColumns({"section": F.count("heading").over(order), "link": link})
    sections = lines.groupBy("path", "section").agg(F.count_if("link").alias("links"))
    pages = rows.where("kind = 'index'").select("path").join(sections.groupBy("path").agg(F.max("section").alias("headings"), F.sum("links").alias("links")), "path", "left")
    found = [
        sections.where("section > 0 and links = 0").select("path", F.lit("okf-index-empty-section").alias("code"), F.col("section").cast("string").alias("detail")),
        lines.where("section = 0 and link").select("path", F.lit("okf-index-link-before-heading").alias("code"), F.col("n").cast("string").alias("detail")),
        pages.where("coalesce(headings, 0) = 0").select("path", F.lit("okf-index-missing-heading").alias("code"), _none().alias("detail")),
        pages.where("coalesce(links, 0) = 0").select("path", F.lit("okf-index-missing-link").alias("code"), _none().alias("detail")),
    ]
    return _union(found, profile)


def log_findings(rows: DataFrame, profile: str) -> DataFrame:
    """Log pages: after one title headings are dates, falling, each with an entry; nothing else stands before the first date."""
    order = Window.partitionBy("path").orderBy("n")
    dated = F.col("heading").isNotNull() & tx.is_iso_date(F.col("heading"))
    lines = _lines(rows, "log").withColumns({"dated": dated, "other": F.col("heading").isNotNull() & ~dated})
    lines = lines.withColumns({"section": F.count_if("dated").over(order), "others": F.count_if("other").over(order), "date": F.when(F.col("dated"), F.col("heading"))})
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("prior", F.last("date", True).over(before))
    # a title is the first heading that is no date, before any date
    wrong = lines.where("other and not (section = 0 and others = 1)").select("path", F.lit("okf-log-invalid-date-heading").alias("code"), F.col("n").cast("string").alias("detail"))
    unordered = lines.where("dated and prior is not null and date >= prior").select("path", F.lit("okf-log-date-order").alias("code"), F.col("date").alias("detail"))
    early = lines.where("heading is null and section = 0").select("path", F.lit("okf-log-entry-before-date").alias("code"), F.col("n").cast("string").alias("detail"))
    groups = lines.where("section > 0").groupBy("path", "section").agg(F.count_if(F.col("heading").isNull()).alias("entries"))
    empty = groups.where("entries = 0").select("path", F.lit("okf-log-empty-date-group").alias("code"), F.col("section").cast("string").alias("detail"))
    dates = rows.where("kind = 'log'").select("path").join(groups.select("path").distinct(), "path", "left_anti")
    missing = dates.select("path", F.lit("okf-log-missing-date-heading").alias("code"), _none().alias("detail"))
    return _union([wrong, unordered, early, empty, missing], profile)


def _union(parts: list[DataFrame], profile: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(profile).alias("profile"), "path", "code", "detail")


# --- the portable profiles -------------------------------------------------------------------------------------------


def portable_profile(docs: DataFrame, policy: Policy | None = None, families: bool = False, ready: DataFrame | None = None) -> DataFrame:
    """Diagnostics of v0.1: readable headers with a type, pages of links and of dates; with `families` of v0.2: the shapes of the optional families too. `ready`: the documents as prepared."""
    profile = PROFILES[families]
    rows = (prepared(docs, strict=False) if ready is None else ready).where(portable(F.col("path"), policy))
    read = _read(rows.select("path", "kind", "opened", "json"))
    floor = read.where("kind = 'concept'").withColumn("code", floor_code()).where("code is not null").select(F.lit(profile).alias("profile"), "path", "code", _none().alias("detail"))
    out = floor.unionByName(index_findings(rows, profile)).unionByName(log_findings(rows, profile))
    if not families:
        return out
    version = F.array_contains("keys", F.lit("okf_version"))
    root = _findings(read.where("path = 'index.md' and v is not null"), profile, [("okf-version-blank", version & (_kind("okf_version") == "STRING") & ~_filled("okf_version")), ("okf-version-non-string", version & (_kind("okf_version") != "STRING"))])
    concepts = _findings(read.where("kind = 'concept' and v is not null"), profile, family_rules(F.col("v")))
    return out.unionByName(root).unionByName(concepts)


# --- the strict profile ----------------------------------------------------------------------------------------------


def cited_links(body: Column) -> Column:
    """Web targets of links from the citations' heading on."""
    at = F.when(F.instr(body, "# Citations") > 0, F.instr(body, "# Citations")).otherwise(F.instr(body, "Citations:"))
    links = F.regexp_extract_all(F.substring(body, at, F.length(body)), F.lit(r"\]\(([^)]*)"), F.lit(1))
    return F.when(at > 0, F.filter(links, lambda x: F.startswith(x, F.lit("http")))).otherwise(F.array().cast("array<string>"))


def _safe(path: Column) -> Column:
    """Not empty, absolute, of a drive or a network share, and without NUL."""
    return ~(path == "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|\x00")


def _resolved(path: Column, target: Column) -> Column:
    """A link's target from the folder of its page; null if it isn't safe or leaves the root."""
    part = F.regexp_replace(target, "#.*$", "")
    full = tx.normalize_path(F.concat_ws("/", tx.directory(path), part))
    return F.when(_safe(part) & (full != ""), full)


def document_rules(policy: Policy | None) -> list[tuple[str, Column]]:
    """The strict rules on one document's header and body."""
    has = lambda section: policy is not None and policy.has(section)
    get = lambda section, key: list(policy.get(section, key))
    statuses = get("status", "allowed") if has("status") else STATUSES
    floor = floor_code()
    absent = ~F.col("opened")
    rules: list[tuple[str, Column]] = [("missing-frontmatter", absent & (floor == "missing-type")), *((code, (floor == code) & ~(absent & F.lit(code == "missing-type"))) for code in ("malformed-frontmatter", "missing-type", "non-string-type", "blank-type"))]
    is_list = _kind("tags") == "ARRAY"
    tags = F.try_variant_get("v", "$.tags", "array<string>")
    boundary = _string("public_boundary")
    headed: list[tuple[str, Column]] = [
        ("title", ~_filled("title")), ("status", ~F.coalesce(_string("okf_status").isin(statuses), F.lit(False))), ("tag", ~is_list), ("freshness", ~_filled("timestamp") & ~_filled("freshness")), ("authority", ~_filled("resource")),
        ("citation-source", ~_filled("resource") & ~F.col("cites")), ("relationship", ~F.col("links")), ("public-boundary", ~_filled("public_boundary")),
    ]
    if has("tags"):
        allowed = _texts(get("tags", "allowed"))
        wrong = F.filter(F.transform(tags, lambda t, i: F.when(~F.array_contains(allowed, F.coalesce(t, F.lit(""))), i.cast("string"))), lambda i: i.isNotNull())
        headed.append(("tag-value", F.when(is_list, wrong)))
    if has("public_boundary"):
        headed.append(("boundary-value", _filled("public_boundary") & ~boundary.isin(get("public_boundary", "values"))))
        headed.append(("public-path-disallowed", boundary.isin(PUBLIC) & ~under_root(F.col("path"), get("public_boundary", "path_allowlist"))))
    if has("frontmatter"):
        headed.append(("fm-required", F.array_except(_texts(get("frontmatter", "required")), F.col("keys"))))
        if policy.fields(True):
            canonical = [p for p in get("document_coverage", "canonical_documents") if p not in get("document_coverage", "native_bundle")]
            allowed = F.when(F.col("path").isin(canonical), _texts(policy.fields(True))).otherwise(_texts(policy.fields())) if canonical else _texts(policy.fields())
            headed.append(("fm-disallowed", F.array_except(F.col("keys"), allowed)))
    if has("source_links"):
        prefix = policy.get("source_links", "require_prefix", "")
        headed.append(("source-link-prefix", F.exists("cited", lambda x: ~F.startswith(x, F.lit(prefix)))))
    # a document without a block has an empty header, one whose block can't be read has none
    read = F.col("v").isNotNull()
    return rules + [(code, F.when(read, found)) for code, found in headed]


def strict_profile(docs: DataFrame, policy: Policy | None = None, ready: DataFrame | None = None) -> DataFrame:
    """Diagnostics of the strict profile: each document's header and body, and, with a policy's coverage, what is missing, unclassified, linked or cited wrongly, or stale. `ready`: the documents as prepared."""
    spark = docs.sparkSession
    rows = prepared(docs, cited=policy is not None and policy.has("source_links")) if ready is None else ready
    get = lambda key: list(policy.get("document_coverage", key)) if policy else []
    path = F.col("path")
    migration = policy.get("frontmatter", "canonical_docs_frontmatter_state", None) if policy else None
    skipped = [*(get("legacy_documents") if migration != "strict" else []), *(get("canonical_documents") if migration == "legacy_baseline" else [])]
    own = (F.col("kind") == "concept") | (path.isin(get("canonical_documents")) if get("canonical_documents") else F.lit(False))
    checked = rows.where(participates(path, policy) & own & (~path.isin(skipped) if skipped else F.lit(True)))
    out = _findings(_read(checked.select("path", "opened", "json", "cites", "links", "cited")), PROFILES[2], document_rules(policy))
    if policy is not None and policy.has("document_coverage"):
        out = out.unionByName(coverage_findings(spark, split_documents(docs), policy, migration))
    return out.unionByName(lifecycle_findings(rows))


def _named(spark: SparkSession, paths) -> DataFrame:
    """A policy's paths; a policy has 64 KB, so they are few."""
    return F.broadcast(spark.createDataFrame([(p,) for p in paths], "path string"))


def coverage_findings(spark: SparkSession, rows: DataFrame, policy: Policy, migration: str | None) -> DataFrame:
    """Findings that need the whole bundle: coverage, native links and orphans, citations, stale claims."""
    get = lambda key: list(policy.get("document_coverage", key))
    native, canonical, bridges = get("native_bundle"), get("canonical_documents"), get("bridge_targets")
    there = rows.select("path")
    missing = _named(spark, policy.classified).join(there, "path", "left_anti").select("path", F.lit("doc-missing").alias("code"), _none().alias("detail"))
    known = [*policy.classified, *policy.excluded]
    loose = there.where(under_root(F.col("path"), get("roots")) & (~F.col("path").isin(known) if known else F.lit(True))).select("path", F.lit("doc-unclassified").alias("code"), _none().alias("detail"))
    parts = [missing, loose]
    if migration == "strict":
        parts.append(_named(spark, get("legacy_documents")).select("path", F.lit("migration-strict-legacy").alias("code"), _none().alias("detail")))
    # native links: pages of the native bundle are named by the policy, so their links are few
    pages = rows.join(_named(spark, native), "path", "left_semi")
    targets = F.filter(F.regexp_extract_all(F.regexp_replace("body", r"!\[[^\[\]\n]*\]\([^)]*\)?", ""), F.lit(r"\]\(([^)]*)"), F.lit(1)), lambda t: ~t.rlike("^(?:http|#|mailto:)"))
    links = pages.select("path", F.explode(targets).alias("detail")).withColumn("target", _resolved(F.col("path"), F.col("detail")))
    code = F.when(F.col("target").isNull(), F.when(F.startswith("detail", F.lit("/")), "native-link-absolute").otherwise("native-link-traversal")).when(~F.col("target").isin([*native, *canonical, *bridges]), "native-link-unconfigured")
    parts.append(links.select("path", code.alias("code"), "detail").where("code is not null"))
    if len(native) > 1:
        inbound = links.where(F.col("target").isin(native) & (F.col("target") != F.col("path"))).select(F.col("target").alias("path")).distinct()
        parts.append(_named(spark, sorted(native)[1:]).join(inbound, "path", "left_anti").select("path", F.lit("native-orphan").alias("code"), _none().alias("detail")))
    # citations and stale claims of native and canonical documents
    subject = rows.join(_named(spark, [*native, *(canonical if migration != "legacy_baseline" else [])]), "path", "left_semi")
    cite = r"([A-Za-z0-9/._\\-]*\.(?:" + "|".join(CITED) + r")):([0-9]*)"
    cited = subject.select("path", F.explode(F.regexp_extract_all("body", F.lit(cite), F.lit(0))).alias("detail"))
    cited = cited.select("path", "detail", F.regexp_extract("detail", "^(.*):", 1).alias("target"), F.coalesce(F.expr("try_cast(regexp_extract(detail, ':([0-9]+)$', 1) as bigint)"), F.lit(0)).alias("line"))
    sizes = rows.join(_named(spark, [*canonical, *bridges]), "path", "left_semi").select(F.col("path").alias("target"), F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("of"))
    cited = cited.join(F.broadcast(sizes), "target", "left")
    configured, bridge = F.col("target").isin([*canonical, *bridges]) if canonical or bridges else F.lit(False), F.col("target").isin(bridges) if bridges else F.lit(False)
    code = (
        F.when(~_safe(F.col("target")) | F.array_contains(F.split("target", "/"), F.lit("..")), "citation-absolute").when(F.col("line") == 0, "citation-invalid-line").when(~configured, "citation-unconfigured").when(F.col("of").isNotNull(), F.when(F.col("line") > F.col("of"), "citation-out-of-range"))
        .when(F.endswith("target", F.lit(".md")) | ~bridge, "citation-missing")
    )
    parts.append(cited.select("path", code.alias("code"), "detail").where("code is not null"))
    stale = _read(subject.select("path", "header", "opened", F.contains("body", F.lit("STALE_CLAIM")).alias("claim")))
    parts.append(stale.where("claim").select("path", F.lit("stale-body").alias("code"), _none().alias("detail")))
    parts.append(stale.where(F.lower(F.trim(_string("freshness"))) == "stale").select("path", F.lit("stale-frontmatter").alias("code"), _none().alias("detail")))
    return _union(parts, PROFILES[2])


# --- lifecycle of packets ----------------------------------------------------------------------------------------------


def lifecycle_findings(rows: DataFrame) -> DataFrame:
    """Helper packets without an active or superseded status, and active documents that refer to superseded ones.

    A reference is a string anywhere in the header or the target of a link. It stands for the document with that path, else for that path from its own
    folder, else, without a slash, for the only document of that name; only documents with a status count.
    """
    own = rows.select("path", "opened", "json", "targets") if "targets" in rows.columns else rows.select("path", "opened", "header", _targets(F.col("body")).alias("targets"))
    read = _read(own).where("v is not null")
    lower = lambda key: F.lower(F.coalesce(_string(key), F.lit("")))
    helper = F.array_contains("keys", F.lit("work_class"))
    for key in ("type", "role"):
        helper = helper | lower(key).isin(HELPERS) | F.contains(lower(key), F.lit("librarian")) | F.contains(lower(key), F.lit("research-assistant"))
    marked = read.select("path", _string("status").alias("status"), helper.alias("helper"), F.concat(F.regexp_extract_all("json", F.lit(r'(?<=[:\[,] ?)"((?:[^"\\]|\\.)*+)"(?! ?:)'), F.lit(1)), "targets").alias("refs"))
    authority = marked.where(F.col("helper") & ~F.coalesce(F.col("status").isin("active", "superseded"), F.lit(False))).select("path", F.lit("packet_missing_authority_field").alias("code"), _none().alias("detail"))
    known = marked.where("status is not null").select("path", "status")
    refs = marked.where("status = 'active'").select("path", F.explode(F.array_distinct("refs")).alias("ref"))
    part = F.regexp_replace("ref", "#.*$", "")
    refs = refs.select("path", part.alias("ref")).where(_safe(F.col("ref")) & ~F.contains("ref", F.lit("://")) & ~F.startswith("ref", F.lit("mailto:"))).distinct()
    refs = refs.withColumn("near", tx.normalize_path(F.concat_ws("/", tx.directory(F.col("path")), F.col("ref"))))
    exact = known.select(F.col("path").alias("ref"), F.col("status").alias("exact"))
    near = known.select(F.col("path").alias("near"), F.col("status").alias("beside"))
    names = known.groupBy(tx.file_name(F.col("path")).alias("ref")).agg(F.count(F.lit(1)).alias("of"), F.first("path").alias("only"), F.first("status").alias("named")).where("of = 1").drop("of")
    found = refs.join(exact, "ref", "left").join(near, "near", "left").join(names, "ref", "left")
    by_name = ~F.contains("ref", F.lit("/")) & (F.col("named") == "superseded")
    target = F.when(F.col("exact").isNotNull(), F.when(F.col("exact") == "superseded", F.col("ref"))).when(F.col("beside").isNotNull(), F.when(F.col("beside") == "superseded", F.col("near"))).when(by_name, F.col("only"))
    old = found.select("path", F.lit("superseded_prompt_reference").alias("code"), target.alias("detail")).where("detail is not null").distinct()
    return authority.unionByName(old).select(F.lit(PROFILES[2]).alias("profile"), "path", "code", "detail")


# --- all profiles ------------------------------------------------------------------------------------------------------


def validate(docs: DataFrame, selected: str, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, outcomes): all three profiles run; an outcome row is (profile, findings, status, selected). An unknown selection is a finding of its own."""
    spark = docs.sparkSession
    ready = prepared(docs, cited=policy is not None and policy.has("source_links"))
    found = portable_profile(docs, policy, ready=ready).unionByName(portable_profile(docs, policy, True, ready)).unionByName(strict_profile(docs, policy, ready))
    if selected not in PROFILES:
        found = found.unionByName(spark.createDataFrame([("selection", "<selection>", "unknown-profile", selected)], "profile string, path string, code string, detail string"))
    counts = found.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    names = F.broadcast(spark.createDataFrame([(p, p in (selected, "selection")) for p in [*PROFILES, *["selection"] * (selected not in PROFILES)]], "profile string, selected boolean"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return found, names.join(counts, "profile", "left").select("profile", n.alias("findings"), F.when(n > 0, "fail").otherwise("pass").alias("status"), "selected")
