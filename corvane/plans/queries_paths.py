"""Paths, roles, budgets and legacy scores over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import brief_units, rules, structural
from ..session import table
from ..sources import corpus

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


_PATH = "case doc_id % 12 when 0 then 'a/test_x' || doc_id || '.py' when 1 then 'b/README.md' when 2 then 'c/d/index.html' when 3 then '.hidden' when 4 then 'e/conf.v' || doc_id || '.yaml' when 5 then 'specs/f.rs' when 6 then 'g/office.docx' when 7 then 'h/tests/i.txt' when 8 then 'noext' when 9 then 'j/k.TOML' when 10 then 'l/latest.go' else 'm/n.tar.gz' end"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text) with paths of many shapes."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} path", "coalesce(text, '') text")


_PARTS = [
    ("test_x' || doc_id || '", "py", "'a'"), ("README", "md", "'b'"), ("index", "html", "'c/d'"), (".hidden", "", "''"), ("conf.v' || doc_id || '", "yaml", "'e'"), ("f", "rs", "'specs'"), ("office", "docx", "'g'"), ("i", "txt", "'h/tests'"), ("noext", "", "''"), ("k", "TOML", "'j'"), ("latest", "go", "'l'"), ("n.tar", "gz", "'m'"),
]
_ROLE = ["test", "doc", "doc", "code", "config", "test", "code", "config", "code", "config", "code", "code"]
_LANGUAGE = ["python", "markdown", "html", None, "yaml", "rust", None, None, None, "toml", "go", None]
_FIELD = ["test_x' || doc_id || '", "b README", "d index", ".hidden", "conf.v' || doc_id || '", "f", "office", "i", "noext", "k", "latest", "n.tar"]


def _by_case(values: list) -> str:
    return "case doc_id % 12 " + " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(values)) + " end"


@query(
    "path_parts",
    f"select doc_id, {_by_case([p[0] for p in _PARTS])} stem, {_by_case([p[1] for p in _PARTS])} extension, case doc_id % 12 " + " ".join(f"when {i} then {p[2]}" for i, p in enumerate(_PARTS)) + f" end directory, {_by_case(_ROLE)} \"role\", {_by_case(_LANGUAGE)} language, {_by_case(_FIELD)} field, doc_id % 12 = 6 excluded from documents",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, extensions, roles, languages, the words of the filename field, and what a brief leaves out."""
    path = F.col("path")
    return paths(spark, sf_dir).select("doc_id", tx.base_name(path).alias("stem"), tx.extension(path).alias("extension"), tx.directory(path).alias("directory"), corpus.path_role(path).alias("role"), tx.language(path).alias("language"), corpus.filename_words(path).alias("field"), corpus.excluded_from_brief(path).alias("excluded"))


_LISTED = "case doc_id % 4 when 0 then '/etc/x' || chr(10) || 'key: v' || chr(10) || 'plain words here' when 1 then 'plain words' || chr(10) || '# remark' || chr(10) || 'a=b' || chr(10) || 'more plain' when 2 then '' else '; only a remark' end"


@query("content_roles", "select doc_id, case doc_id % 3 when 1 then 'code' when 2 then 'config' else case doc_id % 4 when 0 then 'config' else 'doc' end end \"role\" from documents")
def content_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts are documents unless half of their rows are rows of a list."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 3 when 0 then 'a.txt' when 1 then 'a.rs' else 'a.yaml' end path", f"{_LISTED} text")
    return rows.select("doc_id", corpus.content_role(F.col("path"), F.col("text")).alias("role"))


@query("list_rows", "with r as (select doc_id, case doc_id % 7 when 0 then '/a/b' when 1 then './x y' when 2 then 'key: value' when 3 then 'key = value' when 4 then 'two words: x' when 5 then 'C:\\dir' else '~/z' end line from documents) select doc_id, doc_id % 7 in (0, 2, 3, 5, 6) listed from r")
def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are paths or pairs."""
    line = "case doc_id % 7 when 0 then '/a/b' when 1 then './x y' when 2 then 'key: value' when 3 then 'key = value' when 4 then 'two words: x' when 5 then concat('C:', char(92), 'dir') else '~/z' end"
    return table(spark, sf_dir, "documents").select("doc_id", corpus.is_list_row(F.expr(line)).alias("listed"))


@query("normal_paths", "select doc_id, case doc_id % 6 when 0 then 'a/c' || doc_id when 1 then null when 2 then 'b' when 3 then '' when 4 then 'x/y/z' else null end normal from documents")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without dots; null where they leave the top."""
    made = "case doc_id % 6 when 0 then 'a/./b/../c' || doc_id when 1 then '../x' when 2 then './/b/' when 3 then 'a/..' when 4 then 'x/y//z' else 'a/../../b' end"
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_path(F.expr(made)).alias("normal"))


@query("truncations", "with recursive c as (select doc_id, t, 0 n, 0 b from (select doc_id, repeat('aé漢😀', 1 + (doc_id % 20)::int) t from documents) union all select doc_id, t, n + 1, b + octet_length(encode(t[n + 1:n + 1])) from c where n < length(t) and b + octet_length(encode(t[n + 1:n + 1])) <= 57) select doc_id, arg_max(t[1:n], n) head from c group by doc_id")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of 57 bytes that end between characters."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_utf8(F.repeat(F.lit("aé漢😀"), (1 + F.col("doc_id") % 20).cast("int")), 57).alias("head"))


@query("column_names", "select o_orderkey n, case when n > 702 then chr(65 + (((n - 703) // 676) % 26)::int) else '' end || case when n > 26 then chr(65 + (((n - 27) // 26) % 26)::int) else '' end || chr(65 + ((n - 1) % 26)::int) letters from (select distinct o_orderkey, (o_orderkey % 16384 + 1)::int n from orders)".replace("select o_orderkey n, case", "select o_orderkey, n, case"))
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of sheets by number."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 16384 + 1).cast("int").alias("n")).distinct()
    return rows.select("o_orderkey", "n", tx.column_letters(F.col("n")).alias("letters"))


@query("short_reasons", "select doc_id, case doc_id % 3 when 0 then 'exact:filename [docs]' when 1 then 'partial:body' else 'exact:path [a b]' end short, case doc_id % 3 when 1 then 'partial' else 'exact' end kind from documents")
def short_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with their first field, and their kind."""
    reason = F.expr("case doc_id % 3 when 0 then 'exact:filename+body [docs]' when 1 then 'partial:body+description' else 'exact:path [a b]' end")
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_field_reason(reason).alias("short"), tx.match_kind(reason).alias("kind"))


@query("public_excerpts", "select doc_id, case when doc_id % 4 in (0, 1) then case doc_id % 2 when 0 then (coalesce(text, ''))[1:40] else 'body' end end excerpt from documents where coalesce(text, '') = '' or octet_length(encode((coalesce(text, ''))[1:60])) = length((coalesce(text, ''))[1:60])")
def public_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of documents whose boundary is public; texts that begin in ASCII."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') t").where("octet_length(left(t, 60)) = char_length(left(t, 60))")
    text = F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.lit("---\nk: v\n---\nbody"))
    boundary = F.expr("case doc_id % 4 when 0 then array('public') when 1 then array('safe', 'public') when 2 then array('public', 'private') else array() end")
    return docs.select("doc_id", rules.public_excerpt(text, boundary, 40).alias("excerpt"))


@query("generated_from", "select 'part:' || p_partkey src, 'part:' || (p_partkey * 2) dst from part where not exists (select 1 from part q where q.p_partkey = part.p_partkey * 2 and q.p_partkey % 3 <> 0)")
def generated_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of generated nodes whose target is no source."""
    part = table(spark, sf_dir, "part")
    e = part.selectExpr("'generated-from' kind", "'part:' || p_partkey src", "'part:' || (p_partkey * 2) dst").unionByName(part.selectExpr("'design' kind", "'part:' || p_partkey src", "'none' dst"))
    return structural.generated_from_targets(e, part.selectExpr("'part:' || p_partkey id", "case when p_partkey % 3 = 0 then 'generated' else 'source' end role")).select("src", "dst")


# The legacy score as SQL: the question's units are an entity and two words that have no stem.
_L = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNIT = f"""
u as (select * from (values ('doc-12.md', true), ('hend', false), ('src1', false)) t(unit, entity)),
h0 as (select path, active, canonical, public_safe, confidence, unit, entity, contains({_L.format(c='path')}, unit) in_path, contains({_L.format(c="regexp_extract(path, '[^/]*$')")}, unit) in_name, least(len(string_split({_L.format(c="coalesce(text, '')")}, unit)) - 1, 3) hits,
 regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)(^|[^\\p{{L}}\\p{{N}}])' || unit || '([^\\p{{L}}\\p{{N}}]|$)') seg, regexp_matches(path, '(?i)(^|[^\\p{{L}}\\p{{N}}])' || unit || '([^\\p{{L}}\\p{{N}}]|$)') whole, regexp_matches(coalesce(text, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}])' || unit || '([^\\p{{L}}\\p{{N}}]|$)') word from files, u),
h as (select * from h0 where in_path or hits > 0), d as (select unit, count(*) df from h group by unit), t as (select count(*) total from files),
r as (select unit, greatest(length(bin(ratio)) - 17, 0) dbl, ratio from (select unit, ((total + 1) * 65536 // least(df + 1, total + 1)) ratio from d, t)),
w as (select unit, (8 + dbl * 96 + ((((ratio >> dbl::int) - 65536) >> 10) * 3) // 2)::bigint weight from r),
s as (select path, sum(case when entity then 3000 + case when in_path and in_name then 500 when in_path then 350 else 0 end else 2000 + case when in_path and seg then 500 when in_path and in_name then 320 when in_path and whole then 350 when in_path then 180 else 0 end end)::bigint structural, sum(weight)::bigint rarity,
 sum(case when entity then (hits > 0)::int * 25 else (word and hits > 0)::int * 25 end + hits * 10)::bigint detail, any_value(active * 100 + canonical * 50 + public_safe * 20 + confidence)::bigint tie from h join w using (unit) group by path)
"""


def _files_sql() -> str:
    from .queries_rank import FILES_SQL

    return FILES_SQL


@query("brief_units", f"with {_files_sql()}, {_UNIT} select path, structural, rarity, detail, tie from s order by structural desc, rarity desc, detail desc, tie desc, path limit 32")
def brief_units_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by units of a question with an entity and two words."""
    from .queries_rank import files

    return brief_units.rank(brief_units.score(files(spark, sf_dir), "doc-12.md hend src1"))
