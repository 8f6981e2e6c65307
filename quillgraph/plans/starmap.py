"""The star-schema tables seen as a document graph, for queries and benchmarks.

Orders play documents; customers, nations, parts and suppliers are nodes that
foreign keys lead to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the columns of documents."""
    o = table(spark, sf_dir, "orders")
    kind = F.create_map(*[F.lit(x) for pair in zip("12345", ("adr", "design", "spec", "runbook", "incident")) for x in pair])
    trust = F.array(*[F.lit(x) for x in ("authored", "generated", "validated", "external", "untrusted")])
    return o.select(
        F.concat(F.lit("doc:"), "o_orderkey").alias("id"),
        F.concat(F.lit("orders/"), "o_orderkey", F.lit(".md")).alias("path"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("title"),
        kind[F.substring("o_orderpriority", 1, 1)].alias("type"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "draft").alias("status"),
        F.get(trust, F.pmod("o_custkey", F.lit(5)).cast("int")).alias("trust_tier"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"),
        F.array(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("status-"), F.lower("o_orderstatus"))).alias("tags"),
        "o_orderkey", "o_custkey",
    )


ORDER_DOCUMENTS_SQL = """
SELECT 'doc:' || o_orderkey AS id, 'orders/' || o_orderkey || '.md' AS path, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'adr' WHEN '2' THEN 'design' WHEN '3' THEN 'spec' WHEN '4' THEN 'runbook' WHEN '5' THEN 'incident' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'draft' END AS status,
  ['authored', 'generated', 'validated', 'external', 'untrusted'][o_custkey % 5 + 1] AS trust_tier,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at,
  ['P' || substr(o_orderpriority, 1, 1), 'status-' || lower(o_orderstatus)] AS tags, o_orderkey, o_custkey
FROM orders"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges: kind, weight and confidence by the key."""

    def pick(name: str, a: str, x: str, b: str, y: str, kind: str, weight: float, confidence: float) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{a}:"), x).alias("from_id"), F.concat(F.lit(f"{b}:"), y).alias("to_id"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence")
        )

    return (
        pick("nation", "region", "n_regionkey", "nation", "n_nationkey", "CONTAINS", 5.0, 1.0)
        .union(pick("customer", "customer", "c_custkey", "nation", "c_nationkey", "LINKS_TO", 7.0, 0.9))
        .union(pick("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "IMPLEMENTS", 8.0, 1.0))
        .union(pick("orders", "doc", "o_orderkey", "customer", "o_custkey", "DEPENDS_ON", 9.0, 0.85))
        .union(pick("lineitem", "doc", "l_orderkey", "part", "l_partkey", "REFERENCES", 4.0, 0.6))
        .union(pick("lineitem", "doc", "l_orderkey", "supplier", "l_suppkey", "DEFINES", 10.0, 0.75))
    )


EDGES_SQL = """
SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'CONTAINS' AS kind, 5.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LINKS_TO', 7.0, 0.9 FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IMPLEMENTS', 8.0, 1.0 FROM supplier
UNION ALL SELECT 'doc:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON', 9.0, 0.85 FROM orders
UNION ALL SELECT 'doc:' || l_orderkey, 'part:' || l_partkey, 'REFERENCES', 4.0, 0.6 FROM lineitem
UNION ALL SELECT 'doc:' || l_orderkey, 'supplier:' || l_suppkey, 'DEFINES', 10.0, 0.75 FROM lineitem"""
