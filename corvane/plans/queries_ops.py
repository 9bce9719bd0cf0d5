"""Rules, facts, snapshots, logs, gated SQL, sets and scalar functions over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence_log, facts, incremental, packets, rules, symbols
from ..session import table
from ..sources import corpus, sql_gate

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


# A bundle of documents with headers, links and citations; the expressions are SQL that Spark and DuckDB both take.
_PATH = "source || '/doc-' || doc_id || '.md'"
_TEXT = (
    "'---' || chr(10) || case when doc_id % 10 = 0 then '' else 'type: note' || chr(10) end || case when doc_id % 7 = 0 then '' else 'title: Doc ' || doc_id || chr(10) end || 'status: ' || "
    "case doc_id % 5 when 0 then 'deprecated' when 1 then 'draft' when 2 then 'bogus' else 'active' end || chr(10) || 'freshness: 2024-0' || (doc_id % 9 + 1) || '-3' || (doc_id % 3) || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || "
    "'see [next](doc-' || (doc_id + 20) || '.md) and [self](../' || source || '/doc-' || (doc_id + 40) || '.md)' || chr(10) || 'at ' || source || '/doc-' || (doc_id + 20) || '.md:' || (doc_id % 40) || chr(10) || coalesce(text, '')"
)
_BUNDLE = f"b as (select doc_id, {_PATH} path, {_TEXT} txt from documents)"


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a bundle (doc_id, path, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


@query("links_broken", f"with {_BUNDLE}, l as (select path, source_dir || '/doc-' || n || '.md' target from (select path, split_part(path, '/', 1) source_dir, unnest([doc_id + 20, doc_id + 40]) n from b)) select path, target from l where target not in (select path from b)")
def links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to documents that aren't there."""
    return rules.broken_links(bundle(spark, sf_dir))


@query("links_orphans", f"with {_BUNDLE} select path from b where doc_id < 20 and path <> (select min(path) from b)")
def links_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no other links to."""
    return rules.orphans(bundle(spark, sf_dir))


@query(
    "citations_bad",
    f"with {_BUNDLE}, c as (select path, unnest(list_distinct(regexp_extract_all(txt, '[A-Za-z0-9_./-]+\\.(?:rs|py|js|ts|go|java|md|toml|ya?ml|json|sh|sql):[0-9]+'))) c from b), d as (select path, regexp_extract(c, '^(.*):', 1) cited, regexp_extract(c, ':([0-9]+)$', 1)::int line from c), "
    "s as (select path cited, len(string_split(txt, chr(10))) n from b) select path, cited, line, case when n is null then 'citation-missing-file' else 'citation-beyond-end' end code from d left join s using (cited) where n is null or line > n or line = 0",
)
def citations_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of missing files or lines."""
    return rules.bad_citations(bundle(spark, sf_dir))


@query("body_preserved", f"with {_BUNDLE} select path, case when doc_id % 6 = 0 then 'changed' when doc_id % 11 = 0 then 'missing' else 'preserved' end state from b")
def body_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies before and after a migration that rewrites headers, changes some bodies and loses some."""
    before = bundle(spark, sf_dir)
    text = F.concat(F.regexp_replace("text", "(?s)^---\nt", "---\nmigrated: yes\nt"), F.when(F.col("doc_id") % 6 == 0, "changed").otherwise(""))
    after = before.where("doc_id % 11 <> 0 or doc_id % 6 = 0").withColumn("text", text)
    return rules.body_preservation(before, after)


# --- snapshots --------------------------------------------------------------------------------------------------------

_OLD = "old as (select 'p' || doc_id path, sha256(coalesce(text, '')) s from documents where doc_id % 10 <> 1)"
_NEW = "new as (select case when doc_id % 10 = 2 then 'moved/p' else 'p' end || doc_id path, sha256(case when doc_id % 10 = 3 then 'x' else '' end || coalesce(text, '')) s from documents where doc_id % 10 <> 4)"
_DIFF = "d as (select coalesce(old.path, new.path) path, case when old.path is null then 'added' when new.path is null then 'removed' when old.s = new.s then 'reused' else 'changed' end state, old.s old_sha256, new.s sha256 from old full join new using (path))"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: some added, moved, changed and removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias("sha256")
    old = docs.where("doc_id % 10 <> 1").select(F.concat(F.lit("p"), "doc_id").alias("path"), sha(F.col("text")))
    new = docs.where("doc_id % 10 <> 4").select(F.concat(F.when(F.col("doc_id") % 10 == 2, "moved/p").otherwise("p"), "doc_id").alias("path"), sha(F.concat(F.when(F.col("doc_id") % 10 == 3, "x").otherwise(""), "text")))
    return old, new


@query("scan_diff", f"with {_OLD}, {_NEW}, {_DIFF} select * from d")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, changed, removed and reused files."""
    return incremental.scan_diff(*snapshots(spark, sf_dir))


@query(
    "scan_deltas",
    f"with {_OLD}, {_NEW}, {_DIFF}, r as (select old_sha256 digest, count(*) n, min(path) p from d where state = 'removed' group by 1), a as (select sha256 digest, count(*) n, min(path) p from d where state = 'added' group by 1), m as (select digest, r.n rn, a.n an, r.p old_path, a.p path from r join a using (digest)) "
    "select case when rn = 1 and an = 1 then 'rename' else 'ambiguous' end kind, case when rn = 1 and an = 1 then old_path end old_path, case when rn = 1 and an = 1 then path end path, digest from m "
    "union all select 'delete', path, null, old_sha256 from d where state = 'removed' and old_sha256 not in (select digest from m) union all select 'create', null, path, sha256 from d where state = 'added' and sha256 not in (select digest from m) union all select 'change', path, path, sha256 from d where state = 'changed'",
)
def scan_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates, changes, deletes, renames, and ambiguous moves of equal files."""
    return incremental.classify_deltas(incremental.scan_diff(*snapshots(spark, sf_dir)))


@query("snapshot_next", f"with {_OLD}, {_NEW}, {_DIFF} select path, s sha256 from new")
def snapshot_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old snapshot with the changes applied is the new one."""
    old, new = snapshots(spark, sf_dir)
    diff = incremental.scan_diff(old, new)
    changed = new.join(diff.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
    return incremental.apply_changes(old, changed, diff.where("state = 'removed'").select("path"))


@query("snapshot_digest")
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over all files that doesn't depend on their order."""
    return incremental.snapshot_digest(snapshots(spark, sf_dir)[0])


@query("store_eviction", "with y as (select event_id id, user_id created, octet_length(encode(props)) bytes from events where 150 - user_id < 100), n as (select *, row_number() over (order by created desc, id) r, sum(bytes) over (order by created desc, id) total from y) select id, created, bytes from n where r <= 200 and total <= 3000")
def store_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a bounded store keeps."""
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("created"), F.octet_length("props").alias("bytes"))
    return incremental.evict(entries, 150, 100, 200, 3_000)


# --- evidence log ---------------------------------------------------------------------------------------------------

_RANKED = "rk as (select 'q' || (doc_id % 9) request, source bundle, 'doc-' || doc_id locator, (doc_id % 13)::int rank, case doc_id % 4 when 0 then 'exact:path' when 1 then 'partial:path' else 'partial:body' end match_reason from documents union all select 'q' || n_nationkey, 'gone', 'gone-' || n_nationkey, (n_nationkey % 13)::int, 'partial:path' from nation)"


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rankings."""
    row = lambda name, key, bundle, prefix, reason: table(spark, sf_dir, name).select(F.concat(F.lit("q"), (F.col(key) % 9 if name == "documents" else F.col(key)).cast("string")).alias("request"), bundle.alias("bundle"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("locator"), (F.col(key) % 13).cast("int").alias("rank"), reason.alias("match_reason"))
    kind = F.when(F.col("doc_id") % 4 == 0, "exact:path").when(F.col("doc_id") % 4 == 1, "partial:path").otherwise("partial:body")
    return row("documents", "doc_id", F.col("source"), "doc-", kind).unionByName(row("nation", "n_nationkey", F.lit("gone"), "gone-", F.lit("partial:path")))


@query("ranking_diff", f"with {_RANKED}, c as (select request, bundle, locator, case when rank = 5 then 6 else rank end rank, match_reason from rk where locator not like '%7') select coalesce(rk.bundle, c.bundle) bundle, coalesce(rk.locator, c.locator) locator, case when c.locator is null then 'removed' else 'changed' end \"change\" from rk full join c using (bundle, locator) where c.locator is null or rk.rank <> c.rank")
def ranking_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded against current rankings."""
    recorded = rankings(spark, sf_dir)
    current = recorded.where("locator not like '%7'").withColumn("rank", F.when(F.col("rank") == 5, 6).otherwise(F.col("rank")))
    return incremental.ranking_differences(recorded, current, ["bundle", "locator"], ["rank", "match_reason"])


_GAPS = f"""with {_RANKED}, docs as (select 'doc-' || doc_id locator, doc_id from documents union all select 'note-' || s_suppkey, s_suppkey from supplier), lg as (select unnest(['term' || (doc_id % 4), 'word' || (doc_id % 3)]) item from documents),
g as (select 'unanswered-term' kind, item, count(*) n from lg group by item union all select 'retrieved', locator, count(*) from rk group by locator union all select 'path-only', locator, count(*) from rk group by locator having bool_and(match_reason in ('exact:path', 'partial:path'))
union all select 'never-retrieved', locator, 0 from docs where locator not in (select locator from rk) union all select 'unclassified', locator, 0 from docs where doc_id % 2 = 0 union all select 'stale', locator, 1 from docs where doc_id % 8 = 0
union all select distinct 'missing-locator', locator, 0 from rk where locator not in (select locator from docs))"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log shows to be missing."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("locator"), "doc_id")
    there = docs.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("note-"), F.col("s_suppkey").cast("string")).alias("locator"), F.col("s_suppkey").alias("doc_id")))
    log = docs.select(F.array(F.concat(F.lit("term"), (F.col("doc_id") % 4).cast("string")), F.concat(F.lit("word"), (F.col("doc_id") % 3).cast("string"))).alias("unmatched"))
    return evidence_log.gap_summary(log, rankings(spark, sf_dir), there.select("locator"), there.where("doc_id % 2 <> 0").select("locator"), there.where("doc_id % 8 = 0").select("locator", F.lit("freshness").alias("code")))


@query("evidence_gaps", _GAPS + " select kind, item, n from g")
def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by kind."""
    return gaps(spark, sf_dir)


@query("evidence_proposals", _GAPS + " select case kind when 'unanswered-term' then 'add-evidence' when 'path-only' then 'add-metadata' when 'never-retrieved' then 'review-relevance' when 'unclassified' then 'classify' when 'stale' then 'refresh' else 'repair-locator' end \"action\", item from g where kind <> 'retrieved'")
def evidence_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would close the gaps."""
    return evidence_log.proposals(gaps(spark, sf_dir))


@query("recall_metrics", "select event_type \"class\", count(*) questions, count(*) filter (user_id % 12 between 1 and 1) top1, count(*) filter (user_id % 12 between 1 and 5) top5, count(*) filter (user_id % 12 = 0) misses, median(value) median_ms, max(value) worst_ms from events group by event_type")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1, top-5, misses and latencies by class."""
    rank = F.when(F.col("user_id") % 12 > 0, F.col("user_id") % 12)
    return evidence_log.recall(table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), rank.alias("rank"), F.col("value").alias("ms")))


@query("latency_p95", "select event_type, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.5) p50 from events group by event_type")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"))


# --- gated SQL --------------------------------------------------------------------------------------------------------

GATE_CORPUS = [
    ("allowed", "select n_name from main.nation order by 1"), ("allowed", "SELECT r.r_name, count(*) FROM main.region r JOIN main.nation n ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name ORDER BY 2 DESC, 1"),
    ("allowed", 'select "n_name" from "main"."nation" order by 1 limit 5'), ("allowed", "select upper(n_name), coalesce(n_regionkey, 0) from main.nation where n_name like 'A%' and n_regionkey in (1, 2) order by 1"),
    ("unordered", "select n_name from main.nation"), ("compound", "select 1 from main.nation union select 2 from main.nation order by 1"), ("compound", "select (select 1 from main.region) from main.nation order by 1"), ("write-or-ddl", "delete from main.nation"), ("write-or-ddl", "drop table main.nation"),
    ("multi-statement", "select 1 from main.nation order by 1; select 2"), ("comment", "select 1 -- x"), ("comment", "select /* x */ 1 from main.nation order by 1"), ("session-mutation", "set x = 1"), ("procedure-call", "call main.p()"), ("unsafe-function", "select pg_sleep(1) from main.nation order by 1"),
    ("unsafe-function", "select main.count(1) from main.nation order by 1"), ("external-reference", "select 1 from other.main.nation order by 1"), ("relation-not-allowed", "select 1 from main.secret order by 1"), ("unqualified-relation", "select 1 from nation order by 1"), ("not-select", "with x as (1) select 1 from main.nation order by 1"), ("empty", "   "),
    ("unterminated-literal", "select 'x from main.nation order by 1"), ("unsupported-character", "select 1 from main.nation where n_name = 'a\\' order by 1"), ("external-reference", "select @x from main.nation order by 1"), ("malformed", "select 1 from main.nation as where 1 = 1 order by 1"), ("malformed", "select (1 from main.nation order by 1"), ("malformed", "select 1x from main.nation order by 1"),
    ("malformed", "select 1 from main.nation where n_name in main.region order by 1"), ("relation-not-allowed", "select 1 from main.nation, main.secret order by 1"),
]
ALLOWED = ["main.nation", "main.region", "main.customer", "main.orders"]


@query("sql_gate_corpus", "select * from (values " + ", ".join(f"({i}, '{o}')" for i, (o, _) in enumerate(GATE_CORPUS)) + ") t(n, outcome)")
def sql_gate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdicts on a corpus of statements."""
    return spark.createDataFrame([(i, sql_gate.outcome_of(sql, ALLOWED)) for i, (_, sql) in enumerate(GATE_CORPUS)], "n int, outcome string")


GATED = "SELECT c.c_nationkey, count(*), sum(o.o_custkey) FROM main.customer c JOIN main.orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey ORDER BY 2 DESC, 1"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_gate.extract(spark, GATED, {n: table(spark, sf_dir, n.split(".")[1]) for n in ALLOWED}, 20, 300)


_GATED_SQL = "with q as (select row_number() over (order by count(*) desc, c_nationkey) position, '[\"' || c_nationkey || '\",\"' || count(*) || '\",\"' || sum(o_custkey) || '\"]' \"row\" from customer join orders on c_custkey = o_custkey group by c_nationkey), r as (select *, sum(octet_length(encode(\"row\")) + 1) over (order by position)::bigint total_bytes from q)"


@query("sql_extract", _GATED_SQL + ' select position, "row", total_bytes, (select count(*) > count(*) filter (position <= 20 and total_bytes <= 300) from r) truncated from r where position <= 20 and total_bytes <= 300')
def sql_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a gated join and aggregate within row and byte bounds."""
    return _gated(spark, sf_dir)


@query("sql_result_digest", _GATED_SQL + ' select sha256(string_agg("row", chr(10) order by position) || chr(10)) digest, count(*) n_rows from r where position <= 20 and total_bytes <= 300')
def sql_result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the extracted rows."""
    return sql_gate.result_digest(_gated(spark, sf_dir))


# --- facts ------------------------------------------------------------------------------------------------------------


@query("facts_declared", f"with {_BUNDLE} select path, key, value, 'header' provenance, 'declared' confidence from (select path, 'type' key, 'note' value from b where doc_id % 10 <> 0 union all select path, 'title', 'Doc ' || doc_id from b where doc_id % 7 <> 0 union all select path, 'status', case doc_id % 5 when 0 then 'deprecated' when 1 then 'draft' when 2 then 'bogus' else 'active' end from b "
       "union all select path, 'freshness', '2024-0' || (doc_id % 9 + 1) || '-3' || (doc_id % 3) from b union all select path, 'tags', split_part(path, '/', 1) from b union all select path, 'tags', lang from b join documents using (doc_id))")  # fmt: skip
def facts_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of headers; lists give a fact for each item."""
    return facts.declared(bundle(spark, sf_dir))


@query("facts_conflicts", f"with {_BUNDLE} select case when doc_id % 4 = 0 and doc_id % 7 <> 0 then 'ambiguous' else 'resolved' end state, 'title' key, count(*) n from (select doc_id, unnest(list_distinct(list_filter([case when doc_id % 7 <> 0 then 'Doc ' || doc_id end, case when doc_id % 4 = 0 then 'Other' end], lambda x: x is not null))) v from b) group by 1")
def facts_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared title with another one is ambiguous."""
    rows = bundle(spark, sf_dir)
    more = rows.where("doc_id % 4 = 0").select("path", F.lit("title").alias("key"), F.lit("Other").alias("value"), F.lit("import").alias("provenance"), F.lit("inferred").alias("confidence"))
    return facts.resolve(facts.declared(rows).where("key = 'title'").unionByName(more)).groupBy("state", "key").agg(F.count(F.lit(1)).alias("n"))


@query("facts_defaults", f"with {_BUNDLE}, p as (select doc_id, path, split_part(path, '/', 1) dir from b) select path, 'owner' key, case when dir = 'src3' then 'team-3' else 'all' end \"value\" from p union all select path, 'title', 'untitled' from p where doc_id % 7 = 0")
def facts_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of the deepest folder for keys that a file doesn't declare."""
    rows = bundle(spark, sf_dir)
    defaults = spark.createDataFrame([("", "owner", "all"), ("src3", "owner", "team-3"), ("", "title", "untitled")], "dir string, key string, value string")
    return facts.with_defaults(facts.declared(rows), rows, defaults).where("provenance = 'package'").select("path", "key", "value")


@query("facts_maps", f"with {_BUNDLE} select path, map_from_entries(list_filter([('status', [case doc_id % 5 when 0 then 'deprecated' when 1 then 'draft' when 2 then 'bogus' else 'active' end]), case when doc_id % 7 <> 0 then ('title', ['Doc ' || doc_id]) end], lambda x: x is not null)) facts, 50 confidence from b")
def facts_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a node as sorted lists by key."""
    return facts.as_maps(facts.resolve(facts.declared(bundle(spark, sf_dir)).where("key in ('title', 'status')")))


@query("graph_from_facts", f"with {_BUNDLE} select 'known' certainty, count(*) filter (doc_id + 20 in (select doc_id from b)) n from b union all select 'missing-target', count(*) filter (doc_id + 20 not in (select doc_id from b)) from b")
def graph_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of link facts, known if their target is a file."""
    rows = bundle(spark, sf_dir)
    linked = rows.select("path", F.lit("link").alias("key"), F.concat(F.element_at(F.split("path", "/"), 1), F.lit("/doc-"), (F.col("doc_id") + 20).cast("string"), F.lit(".md")).alias("value"), F.lit("body").alias("provenance"), F.lit("inferred").alias("confidence"), F.lit("resolved").alias("state"))
    return facts.graph_rows(rows.select("path", "text"), linked)[1].groupBy("certainty").agg(F.count(F.lit(1)).alias("n"))


@query("page_links", "select page_id, len(list_distinct(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1))) n_links from pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("href=[\"']([^\"'#]+)"), F.lit(1)))).cast("long").alias("n_links"))


# --- symbols and anchors ----------------------------------------------------------------------------------------------

@query("anchor_budgets", "with a as (select 'a' || doc_id id, text from documents), k as (select id, octet_length(encode(text)) n from a where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' and octet_length(encode(text)) <= 8192) select id, n bytes, row_number() over (order by id) position from k qualify position <= 4096")
def anchor_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that aren't blank, not too long, the first 4,096 by id."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), "text")
    return symbols.anchor_budget(rows).select("id", F.octet_length("text").cast("long").alias("bytes"), "position")


@query("claims_grounded", "select doc_id, contains(d.text, b.text) grounded from documents d join benchmark b on b.item_id = d.doc_id % 40")
def claims_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether claims stand in the evidence that they name."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    claims = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(items.withColumnRenamed("text", "claim"), "item_id")
    return claims.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.contains("text", F.col("claim")).alias("grounded"))


# --- sets, windows and scalar functions -----------------------------------------------------------------------------


@query("set_operations", "select 'canonical-only' kind, doc_id from documents where doc_id % 2 = 0 and doc_id % 3 <> 0 union all select 'both', doc_id from documents where doc_id % 6 = 0 union all select 'native-only', doc_id from documents where doc_id % 3 = 0 and doc_id % 2 <> 0")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences and the intersection of two sets of documents."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    a, b = ids.where("doc_id % 2 = 0"), ids.where("doc_id % 3 = 0")
    mark = lambda frame, kind: frame.select(F.lit(kind).alias("kind"), "doc_id")
    return mark(a.exceptAll(b), "canonical-only").unionByName(mark(a.intersect(b), "both")).unionByName(mark(b.exceptAll(a), "native-only"))


@query("allowed_fields", "select source, list_sort(list_distinct(list_concat(['type', 'title'], list_distinct(list(lang))))) fields, list_sort(list_filter(['de', 'en', 'xx'], lambda x: not list_contains(list(lang), x))) missing from documents group by source")
def allowed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions and differences of arrays."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return rows.select("source", F.array_sort(F.array_union(F.array(F.lit("type"), F.lit("title")), "langs")).alias("fields"), F.array_sort(F.array_except(F.array(*map(F.lit, ["de", "en", "xx"])), "langs")).alias("missing"))


@query(
    "valid_descriptions",
    "select 'd' || doc_id path, 'about ' || doc_id description from documents where doc_id % 3 <> 1 and doc_id % 5 <> 2",
)
def valid_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of files out of lines: stale, broken and second ones are dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    line = lambda n: F.to_json(F.struct("path", F.when(F.col("doc_id") % 3 == 1, F.lit("0")).otherwise(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"), F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias("description")))
    first = docs.select((F.col("doc_id") * 2).cast("int").alias("ord"), F.when(F.col("doc_id") % 5 == 2, "broken").otherwise(line("about")).alias("line"))
    second = docs.where("doc_id % 5 <> 2").select((F.col("doc_id") * 2 + 1).cast("int").alias("ord"), line("second").alias("line"))
    return corpus.valid_descriptions(spark, first.unionByName(second), docs.select("path", "text"))


_RUNS = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}._-]+'), lambda r: regexp_replace(r, '^[-_.]+|[-_.]+$', '', 'g')), lambda r: r <> '')"
_ASCII = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("query_entities", f"select doc_id, len(list_distinct(list_transform(list_filter(r, lambda x: octet_length(encode(x)) >= 6 and regexp_matches(x, '[-_.]')), lambda x: {_ASCII.format(x='x')}))) n_entities, len(list_distinct(list_filter(list_transform(list_filter(r, lambda x: not regexp_matches(x, '[-_.]') and octet_length(encode(x)) >= 3), lambda x: {_ASCII.format(x='x')}), lambda x: x not in ({', '.join(chr(39) + w + chr(39) for w in tx.QUERY_STOP_WORDS)})))) n_terms from (select doc_id, {_RUNS} r from documents)")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and terms of every document taken as a question."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.query_entities(text)).cast("long").alias("n_entities"), F.size(tx.query_terms(text)).cast("long").alias("n_terms"))


@query("body_occurrences", "select doc_id, least(len(string_split(lower(coalesce(text, '')), 'tion')) - 1, 3) tion, regexp_matches(coalesce(text, ''), '(^|[^\\p{L}\\p{N}])[Tt][Hh][Ee]([^\\p{L}\\p{N}]|$)') the from documents")
def body_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped counts and whole-word flags."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.occurrences_capped(text, "tion").alias("tion"), tx.has_alnum_token(text, "the").alias("the"))


@query("leads", "select doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10))[1:50], lambda s: regexp_matches(s, '^(# |title:|purpose:|description:|aliases:|tags:)'))[1:4], lambda s: s[1:230]), ' '), '') lead from (select doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || '# ') \"text\" from documents)")
def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title-like lines at the head of documents."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n# "))
    return table(spark, sf_dir, "documents").select("doc_id", tx.lead_of_document(text).alias("lead"))


@query("token_estimates", "select doc_id, octet_length(encode(coalesce(text, ''))) bytes, ceil(octet_length(encode(coalesce(text, ''))) / 4.0)::bigint tokens, length(coalesce(text, '')) chars from documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, estimated tokens and characters."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("bytes"), tx.estimate_tokens(size).alias("tokens"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


@query("iso_dates", "select doc_id, '2023-0' || (doc_id % 9 + 1) || '-' || (25 + doc_id % 8) d, try_cast('2023-0' || (doc_id % 9 + 1) || '-' || (25 + doc_id % 8) as date) is not null valid from documents")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that the calendar has."""
    made = F.concat(F.lit("2023-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), (25 + F.col("doc_id") % 8).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("d"), tx.is_iso_date(made).alias("valid"))


@query("content_digests", "select doc_id, coalesce(case when doc_id % 9 <> 0 then sha256(coalesce(text, '')) end, repeat('0', 64)) digest from documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of selected files, zeros for missing ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 9 != 0, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)), F.repeat(F.lit("0"), F.lit(64))).alias("digest"))


@query("freshness_keys", "select distinct (o_orderdate::varchar)[1:10] freshness, ('0x' || hex(encode((o_orderdate::varchar)[1:8])))::ubigint::decimal(20,0) key from orders")
def freshness_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight bytes of dates as numbers."""
    fresh = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return table(spark, sf_dir, "orders").select(fresh.alias("freshness"), packets.freshness_key(fresh).alias("key")).distinct()


@query("gate_aggregates", "select l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 4) avg_qty, min(l_extendedprice) low, max(l_extendedprice) high, round(sum(l_extendedprice), 2) total from lineitem group by all having count(*) > 1")
def gate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregates that the gate admits, grouped."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.round(F.sum("l_extendedprice"), 2).alias("total")).where("n > 1")


@query("scan_totals", "select source, count(*) files, sum(octet_length(encode(coalesce(text, ''))))::bigint bytes, count(*) filter (octet_length(encode(coalesce(text, ''))) > 8192) oversized from documents group by source")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and oversized files of each root."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.count_if(size > 8192).alias("oversized"))


@query("ignored_paths", "select doc_id, lang || '/' || case doc_id % 4 when 0 then case doc_id % 3 when 0 then 'node_modules/x.md' when 1 then 'vendor/a/x.md' else 'caches/x.md' end when 1 then 'tmp/keep.md' when 2 then 'tmp/a.md' else 'dist/a.md' end path, doc_id % 4 in (0, 2) ignored from documents")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in folders, a rule, and its negation."""
    path = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 3 == 0, "node_modules/x.md").when(F.col("doc_id") % 3 == 1, "vendor/a/x.md").otherwise("caches/x.md")).when(F.col("doc_id") % 4 == 1, "tmp/keep.md").when(F.col("doc_id") % 4 == 2, "tmp/a.md").otherwise("dist/a.md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), corpus.ignored(path, ["tmp", "!keep.md"]).alias("ignored"))


@query("json_rows", "select n_nationkey, '[\"' || n_nationkey || '\",\"' || n_name || '\",\"' || n_regionkey || '\"]' \"row\", sha256('[\"' || n_nationkey || '\",\"' || n_name || '\",\"' || n_regionkey || '\"]') digest from nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON arrays with their digest."""
    row = F.to_json(F.array(*[F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")]))
    return table(spark, sf_dir, "nation").select("n_nationkey", row.alias("row"), F.sha2(F.encode(row, "UTF-8"), 256).alias("digest"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows of events, as the streaming job computes them."""
    from ..streaming.events import windowed

    return windowed(table(spark, sf_dir, "events"))
