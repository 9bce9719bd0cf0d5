"""Excerpts, reasons, packet texts, locators, evidence checks and identities over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection, symbols
from ..session import table
from ..sources import identity, symbol_index
from .star_graph import EDGES_SQL, NODES_SQL, edges, nodes

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


_REASONS = "case relationship when 'dependency' then 'declared_dependency' when 'implementation' then 'declared_implementation' when 'validation' then 'declared_validation' end"


@query(
    "selected_reasons",
    f"with {NODES_SQL}, {EDGES_SQL}, sel as (select id from nodes where id like 'nation:%' or id like 'supplier:%' or id = 'region:1'), f as (select prov_locator path from nodes where prov_source <> 'region'), r as (select dst id, arg_min({_REASONS}, (src, edges.id)) reason from edges join sel on sel.id = src where certainty = 'known' group by dst) "
    "select prov_locator path, case when id like '%:3' then 'metadata_seed' else coalesce(reason, 'declared_relationship') end reason from nodes join sel using (id) join f on f.path = prov_locator left join r using (id)",
)
def selected_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why nations, suppliers and a region are selected; regions are no files."""
    n = nodes(spark, sf_dir)
    chosen = n.where("id like 'nation:%' or id like 'supplier:%' or id = 'region:1'").select("id")
    return selection.selected_sources(n, edges(spark, sf_dir), chosen, chosen.where("id like '%:3'"), n.where("prov_source <> 'region'").select(F.col("prov_locator").alias("path")))


# The excerpt as SQL: lines with the bytes of those taken before them, by a recursive walk.
_EXCERPT = """
with recursive l as (select doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160))), lambda x: x <> '') x from documents),
w(doc_id, i, excerpt) as (select doc_id, 0, '' from l union all select w.doc_id, i + 1, case when octet_length(encode(w.excerpt)) >= 900 then w.excerpt when octet_length(encode(w.excerpt)) < 300 or contains(lower(x[i + 1]), 'tion') then case when w.excerpt = '' then x[i + 1] else w.excerpt || chr(10) || x[i + 1] end else w.excerpt end from w join l using (doc_id) where i < least(len(x), 60)),
e as (select doc_id, arg_max(excerpt, i) excerpt from w group by doc_id)
select doc_id, octet_length(encode(excerpt)) >= 890 long, case when octet_length(encode(excerpt)) < 890 then excerpt else excerpt[1:200] end head from e
"""


@query("excerpts", _EXCERPT)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading lines, then lines with a term; the head of those that were cut. Texts are taken line by line at their sentences, sixty of them."""
    lines = F.array_join(F.slice(F.filter(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "") != ""), 1, 60), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", selection.excerpt(lines, ["tion"]).alias("e"))
    long = F.octet_length("e") >= 890  # near the bound, where SQL doesn't cut between characters
    return docs.select("doc_id", long.alias("long"), F.when(long, F.substring("e", 1, 200)).otherwise(F.col("e")).alias("head"))


@query("term_scores", "select doc_id, (contains(lower(coalesce(text, '')), 'thand')::int + contains(lower(coalesce(text, '')), 'tionble')::int + contains(lower(coalesce(text, '')), 'mail4')::int) score from documents")
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three terms each document holds."""
    return table(spark, sf_dir, "documents").select("doc_id", selection.term_score(F.coalesce("text", F.lit("")), ["thand", "tionble", "mail4"]).alias("score"))


_LOCATED = "select doc_id, case doc_id % 5 when 0 then 'grid' when 1 then 'fixed-layout' when 2 then 'flow' when 3 then 'presentation' else 'else' end family, case when doc_id % 7 = 0 then '' else 'S' || doc_id % 9 end \"name\", (doc_id % 11)::int a, (doc_id % 30)::int b from documents"


@query(
    "native_locators",
    f"with l as ({_LOCATED}) select doc_id, case when family = 'grid' and \"name\" <> '' and a >= 1 and b >= 1 then \"name\" || '!' || case when b > 26 then 'A' || chr(64 + b - 26) else chr(64 + b) end || a when family = 'fixed-layout' and a >= 1 and b >= 1 then 'page ' || a || ' block ' || b when family = 'flow' and \"name\" <> '' and b >= 1 then \"name\" || '#' || b "
    "when family = 'presentation' and a >= 1 and b >= 1 then 'slide ' || a || ' shape ' || b else 'anchor' || doc_id end locator from l",
)
def native_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where anchors of four kinds of documents stand."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 5 when 0 then 'grid' when 1 then 'fixed-layout' when 2 then 'flow' when 3 then 'presentation' else 'else' end family", "case when doc_id % 7 = 0 then '' else 'S' || doc_id % 9 end name", "int(doc_id % 11) a", "int(doc_id % 30) b")
    return rows.select("doc_id", selection.native_locator(F.col("family"), F.col("name"), F.col("a"), F.col("b"), F.concat(F.lit("anchor"), F.col("doc_id").cast("string"))).alias("locator"))


@query(
    "packet_texts",
    f"with {NODES_SQL}, {EDGES_SQL}, rel as (select src id, list(r order by edge) r from (select src, edges.id edge, {_REASONS} || '=' || prov_locator r from edges join nodes on nodes.id = dst where certainty = 'known') where r is not null group by src) "
    "select id, 'path: ' || prov_locator || chr(10) || case when id like 'nation:%' then 'rank: 1' || chr(10) || 'score: exact=1 partial=2 active=3 canonical=0 public_safe=1 confidence=50 freshness=2024' || chr(10) || 'match_reason: exact:path' || chr(10) else 'rank: dependency' || chr(10) end || 'metadata: title=' || prov_locator || ';status=' || case when confidence >= 40 then 'active' else 'draft' end "
    "|| chr(10) || 'relationships: ' || coalesce(array_to_string(r[1:4], ';'), '') || chr(10) || case when id like 'nation:%' then 'content-digest-sha256: ' || repeat('0', 64) || chr(10) else '' end \"text\" from nodes left join rel using (id)",
)
def packet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packets say of each node; nations are ranked and have a digest."""
    n = nodes(spark, sf_dir)
    ranked = n.where("id like 'nation:%'").selectExpr("id", "1 rank", "1 exact", "2 partial", "3 active", "0 canonical", "1 public_safe", "50 confidence", "'2024' freshness", "'exact:path' reason")
    extras = ranked.selectExpr("id", "repeat('0', 64) digest", "cast(null as string) excerpt", "cast(null as string) symbols")
    return selection.item_texts(n.select("id", "prov_locator", "facts"), edges(spark, sf_dir), ranked, extras)


@query(
    "evidence_faults",
    "select * from (select 'd' || doc_id id, case doc_id % 6 when 0 then 'doubled' when 1 then 'missing' when 2 then 'unrelated' when 3 then 'required-without-anchor' when 4 then 'anchor-not-in-content' end fault from documents) where fault is not null",
)
def evidence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that doesn't fit what was selected."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id % 6 k", "'d' || doc_id id")
    evidence = docs.where("k <> 1").unionByName(docs.where("k = 0")).selectExpr("id", "case when k = 3 then 'required' else 'related' end priority", "'the content' content", "case when k = 4 then array('lost') when k = 3 then array() else array('content') end anchors")
    return selection.evidence_faults(docs.where("k <> 2").select("id"), evidence)


@query(
    "bound_excerpts",
    "select 'd' || doc_id path, case doc_id % 5 when 0 then 'digest-mismatch' when 1 then 'not-in-file' when 2 then 'unknown-file' when 3 then 'too-large' end fault from documents where length(text) > 1200",
)
def bound_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts against the files that they are from."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 1200").selectExpr("doc_id % 5 k", "'d' || doc_id path", "text")
    files = docs.where("k <> 2").select("path", "text")
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    made = docs.select("path", F.when(F.col("k") == 1, 4).otherwise(3).alias("start"), F.when(F.col("k") == 3, F.substring("text", 4, 901)).otherwise(F.substring("text", 4, 100)).alias("excerpt"), F.when(F.col("k") == 0, F.sha2(F.lit("else"), 256)).otherwise(sha).alias("sha256"))
    return selection.bound_excerpts(made, files).select("path", "fault")


@query("weak_identities")
def weak_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak identity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return identity.with_weak_identity(docs).select("doc_id", "identity")


_SCAN = "old as (select 'p' || doc_id path, doc_id, sha256(coalesce(text, '')) s from documents where doc_id % 10 <> 1), new as (select 'p' || doc_id path, doc_id, sha256(case when doc_id % 10 = 3 then 'x' else '' end || coalesce(text, '')) s from documents where doc_id % 10 <> 4)"


@query(
    "scan_named_paths",
    f"with {_SCAN} select coalesce(old.path, new.path) path, case when old.path is null then 'added' when new.path is null and old.path in ('p4', 'p14') then 'removed' when old.path in ('p3', 'p13') then 'changed' else 'reused' end state, case when old.path in ('p4', 'p14') then null when old.path in ('p3', 'p13') or old.path is null then new.s else old.s end sha256 from old full join new using (path) where old.path is not null or path in ('p1')",
)
def scan_named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that reads the named paths only: others stay as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias("sha256")
    old = docs.where("doc_id % 10 <> 1").select("path", sha(F.col("text")))
    new = docs.where("doc_id % 10 <> 4").select("path", sha(F.concat(F.when(F.col("doc_id") % 10 == 3, "x").otherwise(""), "text")))
    return identity.scan_changed(old, new, ["p1", "p3", "p4", "p13", "p14"], True)


@query(
    "symbol_names",
    "select distinct 'scip pip pkg 1.0 ' || replace(p_brand, '#', '/') || '/`a b`#p' || p_partkey || '().' symbol, 'p' || p_partkey \"name\", replace(p_brand, '#', '::') || '::a b::p' || p_partkey qualified, true navigable from part union all select distinct 'local ' || p_partkey, null, null, null from part union all select 'scip . . 1 T#(x)', 'T', 'T', false from region where r_regionkey = 0",
)
def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of symbol strings; local ones have none."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.concat(F.lit("scip pip pkg 1.0 "), F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/`a b`#p"), F.col("p_partkey").cast("string"), F.lit("().")).alias("symbol"))
    rows = rows.unionByName(part.select(F.concat(F.lit("local "), F.col("p_partkey").cast("string")).alias("symbol"))).unionByName(spark.createDataFrame([("scip . . 1 T#(x)",)], "symbol string"))
    return symbol_index.with_names(rows.distinct())


# --- symbols ----------------------------------------------------------------------------------------------------------

_SYM = """sym as (select 'p' || p_partkey symbol, p_brand "name", p_partkey % 7 <> 0 navigable, p_partkey from part),
occ as (select 'order-' || l_orderkey path, 'p' || l_partkey symbol, l_linenumber % 4 = 0 definition, l_linenumber start_line, l_linenumber + l_partkey % 3 end_line from lineitem),
rel as (select 'p' || p_partkey symbol, 'p' || (p_partkey + 1) target from part),
rk as (select 'order-' || o_orderkey path, row_number() over (order by o_totalprice desc, o_orderkey) rank from orders where o_orderstatus <> 'O')"""
_FOUND = f"""{_SYM}, w as (select symbol from sym where navigable and lower("name") in ('brand#11', 'brand#12')),
e as (select distinct path, symbol, start_line, end_line, case when definition then 'definition' else 'reference' end "role", null::varchar implements from occ join w using (symbol) union select path, symbol, start_line, end_line, 'implementation', target from occ join rel using (symbol) join w on w.symbol = target where definition),
n as (select row_number() over (order by rank, path, start_line, end_line, "role", symbol, implements nulls first) position, rank, e.* from e join rk using (path))"""


def _symbol_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    from ..operators.structural import number

    part = table(spark, sf_dir, "part")
    sym = part.selectExpr("'p' || p_partkey symbol", "p_brand name", "p_partkey % 7 <> 0 navigable")
    occ = table(spark, sf_dir, "lineitem").selectExpr("'order-' || l_orderkey path", "'p' || l_partkey symbol", "l_linenumber % 4 = 0 definition", "l_linenumber start_line", "l_linenumber + l_partkey % 3 end_line")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    ranked = number(orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "rank").selectExpr("'order-' || o_orderkey path", "rank")
    return sym, occ, part.selectExpr("'p' || p_partkey symbol", "'p' || (p_partkey + 1) target"), ranked


@query("symbol_evidence", f'with {_FOUND} select position, rank, path, start_line, end_line, "role", symbol, implements, (select count(*) > 64 from n) or (select count(*) > (select count(*) from n) from e) truncated from n where position <= 64')
def symbol_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, references and implementations of named symbols in ranked documents, the first 64."""
    sym, occ, rel, ranked = _symbol_tables(spark, sf_dir)
    return symbols.evidence(sym, occ, rel, ranked, ["brand#11", "brand#12"], 64)


@query(
    "symbol_lines",
    f"with {_FOUND} select path, 'scip_symbols: ' || string_agg(\"role\" || ' q' || symbol || ' ' || start_line || '-' || end_line || case when implements is null then '' else ' implements q' || implements end, '; ' order by position) || chr(10) line from n where position <= 64 group by path",
)
def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packets say of each document's symbols."""
    sym, occ, rel, ranked = _symbol_tables(spark, sf_dir)
    return symbols.payload_lines(symbols.evidence(sym, occ, rel, ranked, ["brand#11", "brand#12"], 64), sym.selectExpr("symbol", "'q' || symbol qualified"))


@query("symbol_freshness", "select k, case when k = 0 then 'stale' when k = 1 then 'unverified' when k = 2 then 'unverified' else 'fresh' end state from range(4) t(k)")
def symbol_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded texts against scanned ones: with changes, with missing texts, with missing files, and the same."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "'d' || doc_id path", "coalesce(text, '') || '.' text")
    cases = [docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, "else").otherwise(F.col("text"))), docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text"))), docs.withColumn("path", F.when(F.col("doc_id") % 50 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))), docs]
    out = None
    for k, recorded in enumerate(cases):
        row = symbols.freshness(recorded, docs).select(F.lit(k).cast("long").alias("k"), "state")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "ranked_matches",
    "with m as (select source bundle, lang || doc_id path, 'a' || doc_id id, (doc_id % 7)::int score, doc_id % 3 = 0 ocr from documents where doc_id % 7 > 0), o as (select *, row_number() over (order by ocr, case when ocr then 0 else score end desc, bundle, path, id) position from m) select position, bundle, path, id, case when not ocr then position end rank from o where position <= 400",
)
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document matches by score, derived ones after them without a rank."""
    rows = table(spark, sf_dir, "documents").selectExpr("source bundle", "lang || doc_id path", "'a' || doc_id id", "int(doc_id % 7) score", "case when doc_id % 3 = 0 then 'ocr' else 'embedded' end derivation")
    return symbols.rank_matches(rows, 400)


@query("symbol_words", "select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(head, '[\\p{L}\\p{N}_+$-]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) words from (select doc_id, replace(coalesce(text, ''), 'th', 'T_$') head from documents)")
def symbol_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts that may name symbols."""
    return table(spark, sf_dir, "documents").select("doc_id", symbols.candidates(F.replace(F.coalesce("text", F.lit("")), F.lit("th"), F.lit("T_$"))).alias("words"))


@query("autocompletions", "with c as (select 'Cmd ' || s_name \"text\", s_suppkey ord from supplier order by ord limit 10) select ord, \"text\" from c where lower(\"text\") like 'cmd supplier%' and ord % 2 >= 0 order by ord limit 3")
def autocompletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of ten candidates that begin with what was typed."""
    rows = table(spark, sf_dir, "supplier").selectExpr("'Cmd ' || s_name text", "s_suppkey ord")
    return symbols.autocomplete(rows, "cmd Supplier").select("ord", "text")
