"""Validation, boundary and payload checks over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rules, validation
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


# A bundle whose pages break rules by their number; the expressions are SQL that Spark and DuckDB both take. Pages 0 and 1 of each forty are pages of links and
# of dates, 2 has no header, 3 has a key twice, 4 doesn't close its header; the others leave out or spoil fields by their number.
_N = " || chr(10) || "
_PATH = "source || case when doc_id % 40 = 0 then '/d' || doc_id || '/index.md' when doc_id % 40 = 1 then '/d' || doc_id || '/log.md' else '/doc-' || doc_id || '.md' end"
_HEADER = (
    f"'---'{_N}case doc_id % 9 when 0 then 'owner: me' when 1 then 'type: 5' when 2 then 'type: '''''  else 'type: note' end{_N}case when doc_id % 7 = 0 then 'n: 1' else 'title: Doc ' || doc_id end{_N}'okf_status: ' || case doc_id % 5 when 0 then 'deprecated' when 1 then 'draft' when 2 then 'bogus' else 'active' end"
    f"{_N}case when doc_id % 8 = 0 then 'm: 1' else 'freshness: 2024-01-0' || (doc_id % 9 + 1) end{_N}case when doc_id % 6 = 0 then 'tags: one' else 'tags: [' || lang || ', ' || source || ']' end{_N}case when doc_id % 3 = 0 then 'k: 1' else 'resource: src' end{_N}case when doc_id % 4 = 0 then 'p: 1' else 'public_boundary: public' end"
    f"{_N}case when doc_id % 19 = 0 then 'role: Research-Assistant' else 'q: 1' end{_N}case when doc_id % 2 = 0 then 'status: active' when doc_id % 10 = 5 then 'status: superseded' else 'r: 1' end{_N}case when doc_id % 12 = 7 then 'sources: x' else 's: 1' end{_N}case when doc_id % 17 = 5 then 'stale_after: 2024-02-30' else 't: 1' end{_N}'---'"
)
_BODY = f"case when doc_id % 11 = 0 then 'no link' else '[next](../src' || ((doc_id + 5) % 20) || '/doc-' || (doc_id + 5) || '.md)' end{_N}case when doc_id % 13 = 0 then '# Citations' else 'text' end{_N}coalesce(text, '')"
_TEXT = (
    f"case when doc_id % 120 = 0 then '# Links'{_N}''{_N}'* [a](b.md)'{_N}'# Empty' when doc_id % 120 = 40 then '* [a](b.md)' when doc_id % 120 = 80 then 'plain words' "
    f"when doc_id % 120 = 1 then '# Log'{_N}''{_N}'## 2024-02-30'{_N}'x'{_N}'## 2024-03-02'{_N}'- b'{_N}'## 2024-03-01'{_N}'## 2024-03-05'{_N}'- c' when doc_id % 120 = 41 then 'entry'{_N}'# 2024-01-01' when doc_id % 120 = 81 then '# Title'{_N}'# Other' "
    f"when doc_id % 40 = 2 then 'no header [x](y.md)' when doc_id % 40 = 3 then '---'{_N}'type: a'{_N}'type: b'{_N}'---'{_N}'x' when doc_id % 40 = 4 then '---'{_N}'type: a' else {_HEADER}{_N}{_BODY} end"
)
_BUNDLE = f"b as (select doc_id, doc_id % 40 m, doc_id % 120 g, {_PATH} path, {_TEXT} txt from documents)"


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a bundle (doc_id, path, text) with broken pages."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


def _cases(cases: list[tuple[str, str, str]]) -> str:
    """SQL rows (path, code, detail) of (code, condition, detail) over b."""
    return " union all ".join(f"select path, '{code}' code, {detail} detail from b where {condition}" for code, condition, detail in cases)


_FLOOR = [
    ("missing-type", "m = 2 or m >= 5 and doc_id % 9 = 0", "null"), ("malformed-frontmatter", "m in (3, 4)", "null"), ("non-string-type", "m >= 5 and doc_id % 9 = 1", "null"), ("blank-type", "m >= 5 and doc_id % 9 = 2", "null"),
]
_PAGES = [
    ("okf-index-empty-section", "g = 0", "'2'"), ("okf-index-missing-heading", "g in (40, 80)", "null"), ("okf-index-link-before-heading", "g = 40", "'0'"), ("okf-index-missing-link", "g = 80", "null"),
    ("okf-log-invalid-date-heading", "g = 1", "'2'"), ("okf-log-entry-before-date", "g = 1", "'3'"), ("okf-log-empty-date-group", "g = 1", "'2'"), ("okf-log-date-order", "g = 1", "'2024-03-05'"), ("okf-log-entry-before-date", "g = 41", "'0'"), ("okf-log-empty-date-group", "g = 41", "'1'"),
    ("okf-log-invalid-date-heading", "g = 81", "'1'"), ("okf-log-missing-date-heading", "g = 81", "null"),
]
_FAMILIES = [("status-value", "m >= 5 and doc_id % 2 = 1 and doc_id % 10 = 5", "null"), ("sources-not-sequence", "m >= 5 and doc_id % 12 = 7", "null"), ("stale-after-shape", "m >= 5 and doc_id % 17 = 5", "null")]
_STRICT = [
    ("missing-frontmatter", "m = 2", "null"), ("missing-type", "m >= 5 and doc_id % 9 = 0", "null"), *_FLOOR[1:], ("title", "m = 2 or m >= 5 and doc_id % 7 = 0", "null"), ("status", "m = 2 or m >= 5 and doc_id % 5 = 2", "null"), ("tag", "m = 2 or m >= 5 and doc_id % 6 = 0", "null"),
    ("freshness", "m = 2 or m >= 5 and doc_id % 8 = 0", "null"), ("authority", "m = 2 or m >= 5 and doc_id % 3 = 0", "null"), ("citation-source", "m = 2 or m >= 5 and doc_id % 3 = 0 and not (contains(txt, '# Citations') or contains(txt, 'Citations:') or contains(txt, '[1]'))", "null"),
    ("relationship", "m >= 5 and not contains(txt, '](')", "null"), ("public-boundary", "m = 2 or m >= 5 and doc_id % 4 = 0", "null"), ("packet_missing_authority_field", "m >= 5 and doc_id % 19 = 0 and doc_id % 2 = 1 and doc_id % 10 <> 5", "null"),
    ("superseded_prompt_reference", "m >= 5 and doc_id % 10 = 0 and doc_id % 11 <> 0 and (doc_id + 5) % 40 >= 5 and exists (select 1 from documents t where t.doc_id = b.doc_id + 5)", "'src' || ((doc_id + 5) % 20) || '/doc-' || (doc_id + 5) || '.md'"),
]


@query("validate_base", f"with {_BUNDLE} select 'v0.1' profile, * from ({_cases(_FLOOR + _PAGES)})")
def validate_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable headers with a type, pages of links and of dates."""
    return validation.portable_profile(bundle(spark, sf_dir))


@query("validate_families", f"with {_BUNDLE} select 'v0.2' profile, * from ({_cases(_FLOOR + _PAGES + _FAMILIES)})")
def validate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portable profile with the optional families."""
    return validation.portable_profile(bundle(spark, sf_dir), families=True)


@query("validate_strict", f"with {_BUNDLE} select 'strict' profile, * from ({_cases(_STRICT)})")
def validate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict profile without a policy."""
    return validation.strict_profile(bundle(spark, sf_dir))


@query("validate_outcomes", f"with {_BUNDLE}, o as (select 'v0.1' profile, count(*) findings, true selected from ({_cases(_FLOOR + _PAGES)}) union all select 'v0.2', count(*), false from ({_cases(_FLOOR + _PAGES + _FAMILIES)}) union all select 'strict', count(*), false from ({_cases(_STRICT)})) select profile, findings, case when findings > 0 then 'fail' else 'pass' end status, selected from o")
def validate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profiles with their outcome; the selected one decides."""
    return validation.validate(bundle(spark, sf_dir), "v0.1")[1]


# Lines made from every document's number and first word, so that each code has lines with and without it.
_LINES = (
    "case doc_id % 16 when 0 then 'see /home/ann/notes and more' when 1 then 'a bare /home/ann' when 2 then 'host 10.0.' || doc_id % 256 || '.7 up' when 3 then 'host 10.0.' || doc_id || '.777 up' when 4 then 'in docs/plans/x.md' when 5 then 'our Scoring Formula is' when 6 then 'password = hunter2' || doc_id "
    "when 7 then 'password = <your-password>' when 8 then 'token == abcdefgh' when 9 then '''use token = abcdefgh here''' when 10 then '{\"token\": \"abcdef' || doc_id || '\"}' when 11 then 'x = /secret=abcdefgh/' when 12 then 'mytoken = abcdefgh' when 13 then 'secret: example' when 14 then 'at 172.31.0.1 and /Users/bob/x' else '1192.168.1.70.1' end"
)


@query(
    "boundary_lines",
    "with l as (select doc_id, unnest(case doc_id % 16 when 0 then ['private_home_path'] when 2 then ['private_network_literal'] when 4 then ['internal_agent_path'] when 5 then ['proprietary_scoring_language'] when 6 then ['credential_assignment'] when 10 then ['credential_assignment'] "
    f"when 14 then ['private_home_path', 'private_network_literal'] else [] end) code, {_LINES} line from documents) select 'd' || doc_id path, 1 line_no, code, sha256(line) line_sha256 from l",
)
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what must not cross the boundary, and lines that look like it."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.expr(_LINES).alias("text"))
    return rules.boundary_findings(docs)


@query(
    "boundary_documents",
    "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents) select count(*) n from l where regexp_matches(line, '(^|[^A-Za-z0-9_$-])(api_key|apikey|api-key|token|secret|password)\\s*(:|=)\\s*[\"'']?[A-Za-z0-9._%+/-]{6,}', 'i')",
)
def boundary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of the documents assign a credential; their lines have no quotes before the name."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return rules.boundary_findings(docs).where("code = 'credential_assignment'").agg(F.count(F.lit(1)).alias("n"))


_PAYLOAD = "case doc_id % 8 when 0 then 'see /home/x' when 1 then 'Authorization: Bearer abc' when 2 then 'key sk-abcdefghijk' when 3 then 'key sk-abc' when 4 then '-----BEGIN PRIVATE KEY-----' when 5 then '{\"api_key\": 1}' when 6 then 'Secret=x' else 'task-scheduler ghp' end || ' ' || coalesce(text, '')"


@query(
    "dlp_documents",
    f"with p as (select doc_id, {_PAYLOAD} t from documents), l as (select *, lower(t) l from p) select doc_id, list_filter([case when list_bool_or(list_transform(['api_key', 'token', 'secret', 'password'], lambda k: contains(l, k || '=') or contains(l, k || ':') or contains(l, '\"' || k || '\":'))) then 'credential_assignment' end, case when contains(t, '/home/') then 'private_home_path' end, "
    "case when contains(l, 'bearer ') or contains(l, 'ghp_') or contains(l, 'gho_') or len(list_filter(regexp_extract_all(l, '[a-z0-9_-]+'), lambda r: length(r) >= 12 and regexp_matches(r, '^(sk-|sk_|xoxb-|xoxp-|glpat-|github_pat_)'))) > 0 then 'bearer_or_token' end, case when contains(t, '-----BEGIN PRIVATE KEY-----') then 'private_key' end], lambda x: x is not null) codes from l",
)
def dlp_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every payload holds that must not leave."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.dlp_codes(F.expr(_PAYLOAD)).alias("codes"))


_MORPH = "(values ('tests', 'test'), ('studies', 'study'), ('pinned', 'pin'), ('string', null), ('basis', null), ('boxes', 'box'), ('classes', 'class'), ('falling', 'fall'), ('glass', null), ('bring', null), ('running', 'run'), ('missed', 'miss'), ('cat', null))"


@query("light_stems", f"select * from {_MORPH} t(word, stem)")
def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain stems of single words."""
    words = ["tests", "studies", "pinned", "string", "basis", "boxes", "classes", "falling", "glass", "bring", "running", "missed", "cat"]
    return spark.createDataFrame([(w,) for w in words], "word string").select("word", tx.light_stem(F.col("word")).alias("stem"))


# The stem as SQL, by the same cases: the ending decides, words under five letters and stems under three have none.
_STEM = (
    "case when not regexp_matches({w}, '^[a-z]{{5,}}$') then null when {w} like '%ies' then {w}[:-4] || 'y' when regexp_matches({w}, '(sh|ch|ss|x|z)es$') then {w}[:-3] when regexp_matches({w}, '[^sui]s$') then {w}[:-2] "
    "when {w} like '%ed' then case when length({w}) >= 6 and {w}[-3] = {w}[-4] and not contains('aeiousl', {w}[-3]) then {w}[:-4] else {w}[:-3] end when regexp_matches({w}, '....ing$') then case when {w}[-4] = {w}[-5] and not contains('aeiousl', {w}[-4]) then {w}[:-5] else {w}[:-4] end end"
)
_TOKENS = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: regexp_matches(x, '^[a-z0-9]+$'))"


@query("morph_tokens", f"select doc_id, len(list_filter({_TOKENS}, lambda w: w = 'tion' or case when length({_STEM.format(w='w')}) >= 3 then {_STEM.format(w='w')} end = 'tion')) > 0 tion, len(list_filter({_TOKENS}, lambda w: w = 'ent' or case when length({_STEM.format(w='w')}) >= 3 then {_STEM.format(w='w')} end = 'ent')) > 0 ent, regexp_matches(coalesce(text, ''), '(^|[\\x00-/:-@\\[-`{{-\\x7f])[Tt][Ii][Oo][Nn]|[a-z0-9]T[Ii][Oo][Nn]|[0-9][Tt][Ii][Oo][Nn]') sub from documents")
def morph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts have tokens of a stem, or words that begin with it within others."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.has_morph_token(text, "tion").alias("tion"), tx.has_morph_token(text, "ent").alias("ent"), tx.has_morph_subword(text, "tion", 4).alias("sub"))
