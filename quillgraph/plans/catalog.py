"""Queries over the test tables, one for each operator, and what they equal in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..functions.ids import stable_id
from ..operators import fts, graph, ranking, relate
from . import dsl
from .registry import ORACLES, QUERIES, Query, query  # noqa: F401
from .starmap import EDGES_SQL, ORDER_DOCUMENTS_SQL, edges, order_documents, table

# ------------------------------------------------------------------ full text
def _bm25_sql(prefixes: list[str], name: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{p}'))) AS tf{i}" for i, p in enumerate(prefixes))
    n = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS n{i}" for i in range(len(prefixes)))
    score = " + ".join(
        f"(CASE WHEN ln((n_all - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n_all - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END)"
        f" * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))"
        for i in range(len(prefixes))
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(prefixes)))
    return f"""{name}_tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
{name}_tf AS (SELECT doc_id, len(t) AS len, {tf} FROM {name}_tok),
{name}_st AS (SELECT count(*)::DOUBLE AS n_all, avg(len) AS avg_len, {n} FROM {name}_tf),
{name} AS (SELECT doc_id, round({score}, 6) AS score FROM {name}_tf, {name}_st WHERE {some})"""


def _scored(spark: SparkSession, sf_dir: str, prefixes: list[str]) -> DataFrame:
    found = fts.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", prefixes)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_Q1, _Q2 = ["renew", "onion", "thouin"], ["ndwh", "oni", "entre"]


@query(f"WITH {_bm25_sql(_Q1, 'a')} SELECT doc_id, score FROM a")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _Q1)


@query(f"WITH {_bm25_sql(_Q2, 'a')} SELECT doc_id, score FROM a ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _Q2).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    f"""WITH {_bm25_sql(_Q1, 'a')}, {_bm25_sql(_Q2, 'b')},
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a QUALIFY rank <= 100
UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 100)
SELECT doc_id, round(1000 * sum(1.0::DOUBLE / (60 + rank)), 4) AS boost FROM r GROUP BY doc_id"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    def channel(prefixes: list[str], name: str) -> DataFrame:
        top = _scored(spark, sf_dir, prefixes).orderBy(F.desc("score"), "doc_id").limit(100)
        return top.select("doc_id", F.lit(name).alias("channel"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))  # 100 rows

    return ranking.fuse(channel(_Q1, "first").union(channel(_Q2, "second")), key="doc_id").select("doc_id", "boost")


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term, doc_id FROM documents)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY term"""
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.term_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")


# -------------------------------------------------------------------- vectors
@query(
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q
WHERE vec_id <> qid ORDER BY similarity DESC, vec_id LIMIT 10"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))  # one row
    scored = e.crossJoin(F.broadcast(q)).where("vec_id <> qid").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(10)


@query()
def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, vec_id, similarity: the 10 nearest of every vector, exact; ``cosine_topk`` has those of the first alone."""
    return relate.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


_CENTROIDS = """u AS (SELECT label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS size FROM embeddings),
d AS (SELECT label, i, avg(x / size) AS m FROM (SELECT label, size, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u WHERE size > 0) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS v FROM d GROUP BY label),
p AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a, c b WHERE a.label < b.label)"""


@query(f"WITH {_CENTROIDS} SELECT a, b, similarity FROM p")
def centroid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = relate.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return relate.similar_pairs(centres, "label", -1.0).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {_CENTROIDS}, sides AS (SELECT a AS x, b AS y, similarity FROM p UNION ALL SELECT b, a, similarity FROM p),
k AS (SELECT x, y, similarity FROM sides QUALIFY row_number() OVER (PARTITION BY x ORDER BY similarity DESC, y) <= 3)
SELECT k.x AS a, k.y AS b, k.similarity FROM k JOIN k r ON k.x = r.y AND k.y = r.x WHERE k.x < k.y"""
)
def reciprocal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.reciprocal(centroid_pairs(spark, sf_dir), 3)


# ------------------------------------------------------------ filter language
_DSL = {
    "dsl_filter_text": ('title ~ "urgent" AND status != draft', "contains(lower(title), 'urgent') AND lower(coalesce(status, '')) <> 'draft'"),
    "dsl_filter_enum": ("type = adr OR trust = validated", "type = 'adr' OR trust_tier = 'validated'"),
    "dsl_filter_tag": ("tag = P1 AND NOT tag ~ status-f", "list_contains(list_transform(tags, lambda x: lower(x)), 'p1') AND len(list_filter(tags, lambda x: contains(lower(x), 'status-f'))) = 0"),
    "dsl_filter_date": ("updated >= 1995-03-01 AND updated <= 1995-04-30", "updated_at >= '1995-03-01' AND updated_at < '1995-05-01'"),
    "dsl_filter_nested": (
        '(status = active OR NOT (type = spec AND trust !~ external)) AND path ~ "7"',
        "(lower(coalesce(status, '')) = 'active' OR NOT (type = 'spec' AND NOT contains(trust_tier, 'external'))) AND contains(path, '7')",
    ),
    "dsl_filter_null": ("status !~ a AND updated < 1999-01-01", "NOT contains(lower(coalesce(status, '')), 'a') AND updated_at < '1999-01-01'"),
}


def _dsl_query(source: str) -> Query:
    return lambda spark, sf_dir: dsl.execute(source, order_documents(spark, sf_dir))[0].select("id", "path", "type", "status", "trust_tier", "updated_at")


for _name, (_source, _where) in _DSL.items():
    query(f"WITH d AS ({ORDER_DOCUMENTS_SQL}) SELECT id, path, type, status, trust_tier, updated_at FROM d WHERE {_where}", _name)(_dsl_query(_source))


@query(
    f"""WITH d AS ({ORDER_DOCUMENTS_SQL}) SELECT id, path, status FROM d WHERE type = 'incident'
ORDER BY status DESC NULLS LAST, updated_at ASC, path LIMIT 25"""
)
def dsl_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.execute("type: incident ORDER BY status DESC, updated LIMIT 25", order_documents(spark, sf_dir))[1].select("id", "path", "status")


@query(
    f"""WITH d AS ({ORDER_DOCUMENTS_SQL})
SELECT id, path FROM d SEMI JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON d.o_orderkey = l.l_orderkey
ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'red')) r ON d.o_orderkey = r.l_orderkey WHERE type = 'adr'"""
)
def dsl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = edges(spark, sf_dir).select(F.col("from_id").alias("document_id"), "kind", "to_id")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("text"))
    return dsl.execute('type = adr AND edge = DEFINES AND edge.REFERENCES !~ "red"', order_documents(spark, sf_dir), edge_owner=owner, node_text=parts)[0].select("id", "path")


@query(
    f"""WITH d AS ({ORDER_DOCUMENTS_SQL}) SELECT id, path FROM d WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR type = 'spec'"""
)
def dsl_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_documents(spark, sf_dir)
    lone = docs.join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    health = lone.select(F.col("id").alias("document_id"), F.lit("orphan").alias("state"))
    return dsl.execute("health = orphan OR type = spec", docs, health=health)[0].select("id", "path")


# ---------------------------------------------------------------------- graph
@query(
    f"""WITH e AS ({EDGES_SQL}), x AS (SELECT from_id AS id FROM e WHERE kind <> 'CONTAINS' UNION ALL SELECT to_id FROM e WHERE kind <> 'CONTAINS')
SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 10"""
)
def high_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(10)


@query("SELECT 'part:' || l_partkey AS id, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY l_partkey")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = edges(spark, sf_dir).where("kind = 'REFERENCES'")
    owner = table(spark, sf_dir, "orders").select(F.concat(F.lit("doc:"), "o_orderkey").alias("id"), F.concat(F.lit("doc:"), "o_orderkey").alias("document_id"))
    return graph.document_frequency(refs, owner)


_PARTS = """d AS (SELECT r_regionkey AS k, 'region:' || r_regionkey AS id FROM region),
s AS (SELECT n_regionkey AS k, 'nation:' || n_nationkey AS id FROM nation),
c AS (SELECT n_regionkey AS k, 'supplier:' || s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT 'e' || s_suppkey AS id, 'supplier:' || s_suppkey AS from_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'nation:' || (s_suppkey % 25) WHEN 1 THEN 'region:' || (s_suppkey % 5) ELSE 'supplier:' || (s_suppkey // 2) END AS to_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'DEFINES' ELSE 'LINKS_TO' END AS kind FROM supplier)"""


@query(
    f"""WITH {_PARTS}
SELECT d.id AS document_id, coalesce(sum(CASE WHEN e.kind <> 'CONTAINS' THEN 1 ELSE 0 END), 0)::BIGINT AS raw, count(DISTINCT e.id) AS exact,
  coalesce(sum(CASE WHEN e.kind = 'DEFINES' THEN 1 ELSE 0 END), 0)::BIGINT AS definitions
FROM d LEFT JOIN s ON s.k = d.k LEFT JOIN c ON c.k = d.k
LEFT JOIN e ON e.from_id IN (d.id, s.id, c.id) OR e.to_id IN (d.id, s.id, c.id) GROUP BY d.id"""
)
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    region = lambda c: F.concat(F.lit("region:"), c)
    parts = (
        table(spark, sf_dir, "region").select(region("r_regionkey").alias("document_id"), region("r_regionkey").alias("id"), F.lit("document").alias("part"))
        .union(n.select(region("n_regionkey"), F.concat(F.lit("nation:"), "n_nationkey"), F.lit("section")))
        .union(s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(region("n_regionkey"), F.concat(F.lit("supplier:"), "s_suppkey"), F.lit("chunk")))
    )
    key, third = F.col("s_suppkey"), F.col("s_suppkey") % 3
    links = s.select(
        F.concat(F.lit("e"), key).alias("id"), F.concat(F.lit("supplier:"), key).alias("from_id"),
        F.when(third == 0, F.concat(F.lit("nation:"), key % 25)).when(third == 1, F.concat(F.lit("region:"), key % 5)).otherwise(F.concat(F.lit("supplier:"), F.floor(key / 2))).alias("to_id"),
        F.when(key % 4 == 0, "DEFINES").otherwise("LINKS_TO").alias("kind"), F.lit(None).cast("string").alias("provenance"),
    )
    return graph.link_stats(parts, links)


@query(
    f"""WITH RECURSIVE e AS ({EDGES_SQL}), u AS (SELECT DISTINCT from_id AS x, to_id AS y FROM e WHERE kind IN ('CONTAINS', 'LINKS_TO', 'DEPENDS_ON')),
b AS (SELECT x, y FROM u UNION SELECT y, x FROM u),
w AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT b.y, w.depth + 1 FROM w JOIN b ON b.x = w.id WHERE w.depth < 4)
SELECT id, min(depth) AS depth FROM w GROUP BY id"""
)
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = edges(spark, sf_dir).where("kind IN ('CONTAINS', 'LINKS_TO', 'DEPENDS_ON')")
    start = spark.range(1).select(F.lit("region:0").alias("id"))
    return graph.bfs(tree, start, 4).select("id", "depth")


# ------------------------------------------------------- extraction and health
# ------------------------------------------------------------------- rankings
@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank
FROM lineitem QUALIFY rank <= 3"""
)
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    got = ranking.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3)
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 5 OR i IN (0, floor((n - 1) / 4.0 + 0.5), floor(2 * (n - 1) / 4.0 + 0.5), floor(3 * (n - 1) / 4.0 + 0.5), n - 1)"""
)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.even_sample(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")], 5)


@query(
    f"""WITH {_bm25_sql(_Q2, 'a')}, k AS (SELECT doc_id FROM a ORDER BY score DESC, doc_id LIMIT 20),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM documents SEMI JOIN k USING (doc_id))
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard
FROM w a JOIN w b ON a.doc_id < b.doc_id"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundancy among search results: pairs of the 20 best documents of one text query, not of the whole table."""
    return relate.jaccard_pairs(best_items(spark, sf_dir), "doc_id", "tokens").withColumn("jaccard", F.round("jaccard", 6))


def best_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens of the 20 best documents of a search."""
    top = _scored(spark, sf_dir, _Q2).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id")
    return table(spark, sf_dir, "documents").join(F.broadcast(top), "doc_id").select("doc_id", tx.words(F.col("text")).alias("tokens"))  # 20 rows


# -------------------------------------------------------- differences, events
_OLD = """old AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 11 = 0 THEN c_name || '!' ELSE c_name END AS hash FROM customer WHERE c_custkey % 7 <> 0),
cur AS (SELECT c_custkey AS path, c_name AS hash FROM customer WHERE c_custkey % 13 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("hash"))
    old = c.where("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 11 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    return old, c.where("path % 13 <> 0")


@query(f"WITH {_OLD} SELECT * FROM (FROM old EXCEPT ALL FROM cur) UNION ALL SELECT * FROM (FROM cur EXCEPT ALL FROM old)")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return relate.symmetric_difference(old, new)


@query("SELECT c_custkey, 'entity:' || substr(sha1('entity:' || c_name), 1, 20) AS id FROM customer")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", stable_id("entity", F.col("c_name")).alias("id"))


from . import catalog_library, catalog_papers  # noqa: E402, F401  they register their queries
