"""The graph of the star schema: regions, nations, customers, suppliers, orders and parts, joined by their foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, cut_by, fingerprint, remembered, table

NODES_SQL = """
nodes as (
 select 'region:' || r_regionkey id, 'entrypoint' role, 'region' prov_source, r_name prov_locator, 50 confidence from region
 union all select 'nation:' || n_nationkey, 'document', 'nation', n_name, 50 from nation
 union all select 'customer:' || c_custkey, 'document', 'customer', 'c' || c_custkey, 40 from customer
 union all select 'supplier:' || s_suppkey, case when s_suppkey % 5 = 0 then 'test' else 'symbol' end, 'supplier', 's' || s_suppkey, 25 from supplier
 union all select 'order:' || o_orderkey, 'document', 'orders', 'o' || o_orderkey, 40 from orders
 union all select 'part:' || p_partkey, case when p_partkey % 10 = 0 then 'generated' else 'symbol' end, 'part', 'p' || p_partkey, 25 from part
)"""

EDGES_SQL = """
edges as (
 select 'rn:' || n_nationkey id, 'region:' || n_regionkey src, 'nation:' || n_nationkey dst, 'dependency' relationship, 'known' certainty from nation
 union all select 'nc:' || c_custkey, 'nation:' || c_nationkey, 'customer:' || c_custkey, 'dependency', case when c_custkey % 11 = 0 then 'dynamic' else 'known' end from customer
 union all select 'ns:' || s_suppkey, 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'validation', 'known' from supplier
 union all select 'co:' || o_orderkey, 'customer:' || o_custkey, 'order:' || o_orderkey, 'dependency', case when o_orderkey % 7 = 0 then 'dynamic' else 'known' end from orders
 union all select distinct 'op:' || l_orderkey || ':' || l_partkey, 'order:' || l_orderkey, 'part:' || l_partkey, 'implementation', 'known' from lineitem
)"""


_TABLES = ["region", "nation", "customer", "supplier", "orders", "part", "lineitem"]
#: Bytes of the tables for each bucket of edges, and buckets at least.
_BUCKET_BYTES, _BUCKETS = 8 << 20, 4


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes, built once a session for each state of the tables."""
    return remembered(spark, ("star-nodes", fingerprint(spark, sf_dir, *_TABLES)), lambda: cut(make_nodes(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, built once a session for each state of the tables, dealt by their source."""
    n = buckets(spark, sf_dir)
    return remembered(spark, ("star-edges", fingerprint(spark, sf_dir, *_TABLES)), lambda: cut_by(make_edges(spark, sf_dir, n), "src", n))


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the edges are dealt into: they grow with the tables, so that a task's share doesn't."""
    return max(_BUCKETS, -(-sum(size for _, _, size, _ in fingerprint(spark, sf_dir, *_TABLES)[1:]) // _BUCKET_BYTES))


def make_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, prov_source, prov_locator, confidence, facts)."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def rows(name: str, kind: str, c: str, role, locator, confidence: int) -> DataFrame:
        return t(name).select(key(kind, c).alias("id"), role.alias("role"), F.lit(name).alias("prov_source"), locator.alias("prov_locator"), F.lit(confidence).alias("confidence"))

    short = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    out = rows("region", "region", "r_regionkey", F.lit("entrypoint"), F.col("r_name"), 50)
    out = out.unionByName(rows("nation", "nation", "n_nationkey", F.lit("document"), F.col("n_name"), 50))
    out = out.unionByName(rows("customer", "customer", "c_custkey", F.lit("document"), short("c", "c_custkey"), 40))
    out = out.unionByName(rows("supplier", "supplier", "s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "test").otherwise("symbol"), short("s", "s_suppkey"), 25))
    out = out.unionByName(rows("orders", "order", "o_orderkey", F.lit("document"), short("o", "o_orderkey"), 40))
    out = out.unionByName(rows("part", "part", "p_partkey", F.when(F.col("p_partkey") % 10 == 0, "generated").otherwise("symbol"), short("p", "p_partkey"), 25))
    facts = F.create_map(F.lit("kind"), F.array("prov_source"), F.lit("title"), F.array("prov_locator"), F.lit("status"), F.array(F.when(F.col("confidence") >= 40, "active").otherwise("draft")))
    return out.withColumn("facts", facts)


def make_edges(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(id, src, dst, relationship, certainty) in n partitions by source; the one shuffle of line items also serves to find their distinct pairs."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def rows(frame: DataFrame, prefix: str, c: str, src, dst, relationship: str, certainty) -> DataFrame:
        return frame.select(key(prefix, c).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(relationship).alias("relationship"), certainty.alias("certainty"))

    known = F.lit("known")
    doubtful = lambda c, n: F.when(F.col(c) % n == 0, "dynamic").otherwise("known")
    out = rows(t("nation"), "rn", "n_nationkey", key("region", "n_regionkey"), key("nation", "n_nationkey"), "dependency", known)
    out = out.unionByName(rows(t("customer"), "nc", "c_custkey", key("nation", "c_nationkey"), key("customer", "c_custkey"), "dependency", doubtful("c_custkey", 11)))
    out = out.unionByName(rows(t("supplier"), "ns", "s_suppkey", key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "validation", known))
    out = out.unionByName(rows(t("orders"), "co", "o_orderkey", key("customer", "o_custkey"), key("order", "o_orderkey"), "dependency", doubtful("o_orderkey", 7)))
    out = out.repartition(n, "src")
    pairs = t("lineitem").select(key("order", "l_orderkey").alias("src"), "l_partkey").repartition(n, "src").dropDuplicates(["src", "l_partkey"])
    part = F.col("l_partkey").cast("string")
    pairs = pairs.select(F.concat(F.lit("op:"), F.substring("src", 7, 20), F.lit(":"), part).alias("id"), "src", F.concat(F.lit("part:"), part).alias("dst"), F.lit("implementation").alias("relationship"), known.alias("certainty"))
    return out.unionByName(pairs)
