"""Stage ranking, traversal and structural parse over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..operators import stages, structural
from ..session import table
from ..sources import structural_parse

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


# Parts as structural nodes; each is linked with the next one and with the one of twice its number. The expressions are SQL that Spark and DuckDB both take.
_K = "p_partkey"
_NODE = (
    f"'part:' || {_K} id, 'parts/' || {_K} % 3 || '/' || {_K} || '.md' path, case when {_K} % 3 <> 0 then 'team-' || {_K} % 7 end owner, p_brand domain, case {_K} % 10 when 0 then 'superseded' when 1 then 'draft' when 2 then 'archive' when 3 then 'rejected' when 4 then 'superseded' else 'current' end lifecycle, "
    f"case {_K} % 4 when 0 then 'canonical' when 1 then 'approved' when 2 then 'supporting' else 'unknown' end authority, case {_K} % 6 when 0 then 'generated' when 1 then 'preextracted' else 'source' end generated_status, {_K} % 900 raw"
)
_NEXT = f"'e' || {_K} id, case {_K} % 5 when 0 then 'dependency' when 1 then 'design' when 2 then 'validation' when 3 then 'supersedes' else 'predecessor' end kind, 'part:' || {_K} src, 'part:' || ({_K} + 1) dst, 'l' || {_K} % 4 locator, case when {_K} % 11 = 0 then 'dynamic' else 'known' end certainty"
_TWICE = f"'f' || {_K} id, 'impact' kind, 'part:' || {_K} src, 'part:' || (2 * {_K}) dst, 'm' locator, 'known' certainty"
_GRAPH = f"sn as (select {_NODE} from part), se as (select {_NEXT} from part union all select {_TWICE} from part), ke as (select * from se where certainty = 'known')"


def snodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structural nodes."""
    return table(spark, sf_dir, "part").selectExpr(*_split(_NODE)).withColumn("domains", F.array("domain")).drop("domain")


def sedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between parts."""
    part = table(spark, sf_dir, "part")
    return part.selectExpr(*_split(_NEXT)).unionByName(part.selectExpr(*_split(_TWICE)))


def _split(columns: str) -> list[str]:
    """The expressions of a list; commas stand between columns only."""
    return columns.split(", ")


def _at(column: str, names: list[str]) -> str:
    return f"list_position([{', '.join(repr(n) for n in names)}], {column})"


_REQUEST = stages.StageRequest("part:7", "design", ("Brand#11", "Brand#12", "Nope#1"), ("validation", "business-flow"), 25)
_RANKED = f"""{_GRAPH}, dk as (select id, list(distinct kind) kinds from (select src id, kind from ke where 'part:7' in (src, dst) union all select dst, kind from ke where 'part:7' in (src, dst)) group by id),
pre as (select distinct id from (select dst id from ke join sn on sn.id = src and lifecycle = 'current' where kind in ('supersedes', 'predecessor') union all select src from ke join sn on sn.id = dst and lifecycle = 'current' where kind in ('supersedes', 'predecessor'))),
k as (select id, path, domain, coalesce(kinds, []) kinds, lifecycle = 'current' eligible, authority || case when owner is null then '-unowned' else '-owned' end authority_key, case when lifecycle = 'superseded' and id in (select id from pre) then 'predecessor' else lifecycle end revision_key,
 case when lifecycle in ('archive', 'rejected') then lifecycle when generated_status = 'source' then 'source' else 'generated-or-preextracted' end artifact_key, case when id = 'part:7' then 'seed' when kinds is null then 'absent' else 'direct' end distance_key, case when id = 'part:7' then 'exact' when contains(id, 'part:7') then 'partial' else 'none' end relevance_key,
 ((domain in ('Brand#11', 'Brand#12'))::int + list_contains(coalesce(kinds, []), 'validation')::int + list_contains(coalesce(kinds, []), 'design')::int) contribution, least(raw, {M.FREQUENCY_CAP}) frequency, raw > {M.FREQUENCY_CAP} capped from sn left join dk using (id)),
r as (select *, row_number() over (order by eligible desc, {_at('authority_key', stages.AUTHORITY_KEYS)}, {_at('revision_key', stages.REVISION_KEYS)}, {_at('artifact_key', stages.ARTIFACT_KEYS)}, {_at('distance_key', stages.DISTANCE_KEYS)}, {_at('relevance_key', stages.RELEVANCE_KEYS)} desc, contribution desc, frequency desc, path, id) position from k),
d as (select *, case when not eligible then 'lifecycle-conflict' when position <= 25 then 'selected' else 'selection-limit' end decision from r)"""
_KEYS = "id, position, eligible, authority_key, revision_key, artifact_key, distance_key, relevance_key, contribution, frequency, capped, decision"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = snodes(spark, sf_dir)
    return stages.rank(nodes, sedges(spark, sf_dir), nodes.select("id", "raw"), _REQUEST)


@query("stage_ranking", f"with {_RANKED} select {_KEYS} from d")
def stage_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the ten parts of the rank key; the first 25 eligible ones are selected."""
    return _ranked(spark, sf_dir).select(*_KEYS.split(", "))


@query("stage_missing_evidence", f"with {_RANKED}, got as (select list(domain) dd, flatten(list(kinds)) kk from d where decision = 'selected') select (select coalesce(list(x), []) from (select unnest(['Brand#11', 'Brand#12', 'Nope#1']) x) where not list_contains(dd, x)) domains, (select coalesce(list(x), []) from (select unnest(['validation', 'business-flow']) x) where not list_contains(kk, x)) classes from got")
def stage_missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no selected node covers."""
    return stages.missing_evidence(_ranked(spark, sf_dir), _REQUEST)


@query(
    "ranking_receipt_faults",
    f"with {_RANKED} select id, case when position = 1 then 'missing-candidate' when position = 2 then 'path-differs' when position = 3 then 'decision-differs' end fault from d where position <= 3 union all select 'part:none', 'unknown-node'",
)
def ranking_receipt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt that was tampered with: a candidate is gone, one has another path, one another decision, and one is made up."""
    nodes = snodes(spark, sf_dir)
    good = _ranked(spark, sf_dir)
    bad = good.where("position <> 1").withColumns({"path": F.when(F.col("position") == 2, "else").otherwise(F.col("path")), "decision": F.when(F.col("position") == 3, "lifecycle-conflict").otherwise(F.col("decision"))})
    made = good.where("position = 1").withColumn("id", F.lit("part:none"))
    return stages.ranking_faults(nodes, bad.unionByName(made), _REQUEST)


_KINDS = "('dependency', 'design', 'validation', 'impact')"


@query(
    "structural_traversal",
    f"with recursive {_GRAPH}, both_ways as (select src a, dst b from ke where kind in {_KINDS} union select dst, src from ke where kind in {_KINDS}), r(id, depth) as (select 'part:7', 0 union select b, depth + 1 from r join both_ways on a = r.id join sn on sn.id = b where depth < 4) select id, min(depth) as depth from r group by id",
)
def structural_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search in both directions visits within four steps."""
    found = stages.traverse(snodes(spark, sf_dir), sedges(spark, sf_dir), "part:7", ["dependency", "design", "validation", "impact"], 4, 4_096)
    return found.rows(spark).select("id", "depth")


@query("predecessor_nodes", f"with {_RANKED} select id from sn where lifecycle = 'superseded' and id in (select id from pre)")
def predecessor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superseded nodes with a known lineage edge to a current one."""
    nodes = snodes(spark, sf_dir)
    return nodes.where("lifecycle = 'superseded'").select("id").join(stages.predecessor_ids(nodes, sedges(spark, sf_dir)), "id", "left_semi")


@query(
    "lineage_reciprocity",
    f"with {_GRAPH}, s as (select distinct src, dst from se where kind = 'supersedes'), p as (select distinct dst src, src dst from se where kind = 'supersedes' and not suffix(src, '3') union select src, dst from se where kind = 'predecessor') select 'supersedes-without-predecessor' rule, * from s where (src, dst) not in (select src, dst from p) union all select 'predecessor-without-supersedes', * from p where (src, dst) not in (select src, dst from s)",
)
def lineage_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage edges without their counterpart, where most supersessions got one the wrong way round."""
    e = sedges(spark, sf_dir).select("kind", "src", "dst")
    turned = e.where("kind = 'supersedes' and not endswith(src, '3')").select(F.lit("predecessor").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return structural.lineage_reciprocity(e.unionByName(turned))


@query("missing_domains", f"with {_GRAPH} select list(d order by d) missing from (select unnest(['Brand#11', 'Brand#12', 'Nope#1']) d) where d not in (select domain from sn where lifecycle = 'current')")
def missing_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required domains that no current node covers."""
    return structural.missing_domains(snodes(spark, sf_dir).where("lifecycle = 'current'"), ["Brand#11", "Brand#12", "Nope#1"])


@query("tier_counts", f"with {_GRAPH} select case when authority = 'canonical' and lifecycle = 'current' then 'primary-canonical' when lifecycle = 'superseded' then 'conflict-or-superseded' when lifecycle = 'current' then 'required-dependency' else 'follow-up' end tier, count(*) n, sum(octet_length(encode(id || domain)))::bigint bytes from sn group by 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and bytes of each packet tier."""
    return structural.tier_counts(snodes(spark, sf_dir).withColumn("bytes", F.octet_length(F.concat("id", F.get("domains", F.lit(0)))).cast("long")))


# --- structural parse -------------------------------------------------------------------------------------------------

_FILE = "case doc_id % 12 when 0 then 'a/x' || doc_id || '.md' when 1 then 'b/x' || doc_id || '.PY' when 2 then 'c/x' || doc_id || '.mmd' when 3 then 'd/x' || doc_id || '.toml' when 4 then 'e/x' || doc_id || '.rst' when 5 then 'f/x' || doc_id || '.bin' when 6 then 'g/x' || doc_id when 7 then '/abs/' || doc_id || '.md' when 8 then 'h/../' || doc_id || '.md' when 9 then 'auth/x' || doc_id || '.yaml' when 10 then 'C:/x' || doc_id || '.md' else 'ci/x' || doc_id || '.ini' end"
_TYPE = "case doc_id % 12 when 1 then 'code' when 2 then 'mermaid' when 3 then 'metadata' when 4 then 'text' when 5 then null when 6 then null when 9 then 'metadata' when 11 then 'metadata' else 'markdown' end"


def files(spark: SparkSession, sf_dir: str, text: str = "coalesce(text, '')") -> DataFrame:
    """Documents under paths of many kinds."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_FILE} path", f"{text} text")


@query("structural_status", f"select {_FILE} path, {_TYPE} source_type, case when doc_id % 12 in (7, 8, 10) then 'unsafe-path' when doc_id % 12 in (5, 6) then 'unsupported-type' when octet_length(encode(coalesce(text, ''))) > 1048576 then 'oversized' else 'accepted' end status from documents")
def structural_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a structural parse takes, as what."""
    return structural_parse.parse(files(spark, sf_dir))


@query("boundary_markers", f"select {_FILE} path, doc_id % 12 in (9, 11) or contains(lower(coalesce(text, '')), 'none of these') restricted from documents")
def boundary_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at a boundary by their path."""
    return files(spark, sf_dir).select("path", structural_parse.boundary_marker(F.col("path"), F.col("text")).alias("restricted"))


_DIAGRAM = "'graph TD' || chr(10) || '  a' || doc_id || ' --> b-' || doc_id % 5 || chr(10) || 'c d --> e' || chr(10) || 'f-->g'"


@query("mermaid_edges", f"select {_FILE} path, unnest(['a' || doc_id, 'f']) src, unnest(['b-' || doc_id % 5, 'g']) dst, unnest([2, 4]) line from documents where doc_id % 12 = 2")
def mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows of diagrams."""
    return structural_parse.mermaid_edges(files(spark, sf_dir, _DIAGRAM))


_SETTINGS = "'[head]' || chr(10) || '# remark' || chr(10) || 'name = \"doc ' || doc_id || '\"' || chr(10) || 'url: x=y' || chr(10) || case when doc_id % 12 = 9 then 'no sign here' when doc_id % 12 = 11 then 'list = [1]' else 'n: ' || doc_id end"


@query("bare_metadata_errors", f"with f as (select doc_id, {_FILE} path from documents where doc_id % 12 in (3, 9, 11)) select path, 4 line, 'unsupported-scalar' error from f union all select path, 5, case when doc_id % 12 = 9 then 'not-key-value' else 'unsupported-scalar' end from f where doc_id % 12 in (9, 11)")
def bare_metadata_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of settings files that are no facts: `url: x=y` has `url: x` as its key."""
    return structural_parse.bare_metadata(files(spark, sf_dir, _SETTINGS))[1]


_PLAIN = "'name = \"doc ' || doc_id || '\"' || chr(10) || '' || chr(10) || 'n: ' || doc_id"


@query("settings_facts", f"select {_FILE} path, unnest(['name', 'n']) key, unnest(['doc ' || doc_id, doc_id::varchar]) \"value\", unnest([1, 3]) line from documents where doc_id % 12 in (3, 9, 11)")
def settings_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of settings files."""
    return structural_parse.bare_metadata(files(spark, sf_dir, _PLAIN))[0]


@query("fact_locators", "with p as (select doc_id, coalesce(list_position(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, 'th') and contains(x, 'ion')), true), 0) n from documents) select doc_id, case when n > 0 then 'd:' || n else 'd:inferred:th' end locator from p")
def fact_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that has a key and a value."""
    return table(spark, sf_dir, "documents").select("doc_id", structural_parse.fact_locator(F.lit("d"), F.coalesce("text", F.lit("")), F.lit("th"), F.lit("ion")).alias("locator"))


_RELATIONS = "case doc_id % 6 when 0 then 'dependency' when 1 then 'business_flow' when 2 then 'generated_from' when 3 then 'title' when 4 then 'source_link' else 'ownership' end"
_EDGE_SQL = f"with f as (select doc_id, 'd' || doc_id path, 'd' || (doc_id + 700) \"value\", {_RELATIONS} k from documents), e as (select *, replace(k, '_', '-') kind, value in (select path from f) there from f where k <> 'title') "


@query("structural_edges", _EDGE_SQL + "select path || '|' || kind || '|' || \"value\" id, kind, path src, case when there then \"value\" else sha256('missing' || chr(10) || \"value\") end dst, path locator, case when there then 'known' else 'missing-target' end certainty from e")
def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of relation facts; targets that no file has get an id of their own."""
    rows = table(spark, sf_dir, "documents").selectExpr("'d' || doc_id path", f"{_RELATIONS} key", "'d' || (doc_id + 700) value")
    return structural_parse.structural_edges(rows, rows.select("path"))


@query(
    "node_states",
    "select 'd' || doc_id path, case doc_id % 4 when 0 then 'current' when 1 then 'archive' when 2 then 'current' else 'gone' end lifecycle, case doc_id % 3 when 0 then 'canonical' else 'unknown' end authority, case doc_id % 5 when 0 then 'generated' when 1 then 'preextracted' else 'source' end generated_status, case doc_id % 4 when 3 then 'lifecycle' end error from documents",
)
def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States out of facts: the least value of a key counts, and wrong ones are errors."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.selectExpr(
        "'d' || doc_id path",
        "explode(array(struct('lifecycle' key, case doc_id % 4 when 0 then 'draft' when 1 then 'archive' when 2 then null else 'gone' end value), struct('lifecycle' key, case doc_id % 4 when 0 then 'current' end value), struct('authority' key, case doc_id % 3 when 0 then 'canonical' when 1 then 'unknown' end value), "
        "struct('type' key, case doc_id % 5 when 0 then 'generated' else 'note' end value), struct('generated_status' key, case doc_id % 5 when 1 then 'preextracted' end value))) f",
    )
    return structural_parse.node_states(facts.select("path", "f.key", "f.value").where("value is not null or key = 'type'"))


@query("evidence_classes", f"with {_GRAPH} select kind, case when kind in ('requirement', 'design', 'implementation', 'validation', 'architecture', 'business-flow') then kind end class, count(*) n from se group by kind")
def evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence classes of the edges' kinds."""
    return sedges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", stages.evidence_class(F.col("kind")).alias("class"), "n")
