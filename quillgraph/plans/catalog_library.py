"""Queries that run the product's own operators over the library, and what they equal in SQL."""

from __future__ import annotations

import bisect
from dataclasses import replace
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..model import Config, GraphTables
from ..operators import context, diff, evaluate, export, extract, fts, graph, health, nodes, resolve, search
from ..sources.store import counts
from ..streaming import watch
from . import dsl
from .library import LIBRARY_SQL, library
from .registry import ORACLES, query
from .starmap import table

_WITH = f"WITH {LIBRARY_SQL}"

# ---------------------------------------------------------------------- search
_QUERY, _LIMIT, _COMMON = "`Erreth` renew thing Inonth onion", 10, 3
_PREFIXES = ("erreth", "renew", "thing", "inonth", "onion")
_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīłńňōőřśşšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegilnnoorsssttuuuzzz"[:54]


def _indexed_bm25(source: str, id_: str, text: str, prefixes: tuple[str, ...]) -> str:
    """x_bm25: id, score; matches and lengths of the folded stream, frequencies of the plain words."""
    some = lambda i, p: f"(len(list_filter(folded, lambda x: starts_with(x, '{p}'))) > 0) AS hit{i}, len(list_filter(plain, lambda x: starts_with(x, '{p}'))) AS tf{i}"
    cols = ", ".join(some(i, p) for i, p in enumerate(prefixes))
    n = ", ".join(f"sum(hit{i}::INT)::DOUBLE AS n{i}" for i in range(len(prefixes)))
    score = " + ".join(
        f"(CASE WHEN ln((n_all - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n_all - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))"
        for i in range(len(prefixes))
    )
    any_hit = " OR ".join(f"hit{i}" for i in range(len(prefixes)))
    return f"""x_tok AS (SELECT {id_} AS id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS plain, regexp_extract_all(translate(lower({text}), '{_FROM}', '{_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS folded FROM {source}),
x_tf AS (SELECT id, len(folded) AS len, {cols} FROM x_tok),
x_st AS (SELECT count(*)::DOUBLE AS n_all, avg(len) AS avg_len, {n} FROM x_tf),
x_bm25 AS (SELECT id, {score} AS score FROM x_tf, x_st WHERE {any_hit})"""


_BOOSTS = """CASE trust_tier WHEN 'validated' THEN 8.0 WHEN 'authored' THEN 5.0 WHEN 'generated' THEN -5.0 WHEN 'external' THEN -10.0 WHEN 'untrusted' THEN -30.0 ELSE 0.0 END
  + CASE status WHEN 'deprecated' THEN -20.0 WHEN 'superseded' THEN -20.0 WHEN 'draft' THEN -8.0 WHEN 'archived' THEN -8.0 ELSE 0.0 END"""

_SEARCH_SQL = f"""{_WITH}, {_indexed_bm25("l_chunks", "id", "content", _PREFIXES)},
asked(pos, normalized_name) AS (VALUES (0, 'erreth'), (1, 'inonth')),
m AS (SELECT pos, e.* FROM asked JOIN l_entities e USING (normalized_name)),
sides AS (SELECT from_id AS id, to_id AS other FROM l_edges WHERE kind <> 'CONTAINS' UNION ALL SELECT to_id, from_id FROM l_edges WHERE kind <> 'CONTAINS'),
freq AS (SELECT s.id, count(DISTINCT document_id) AS documents FROM sides s JOIN l_owners o ON s.other = o.id GROUP BY s.id),
known AS (SELECT m.pos, m.id, m.name, m.normalized_name, coalesce(f.documents, 0) AS documents FROM m LEFT JOIN freq f ON f.id = m.id),
defs AS (SELECT k.pos, e.id AS eid, e.weight, s.id AS section_id, coalesce(s.document_id, e.from_id) AS document_id, s.start_line FROM l_edges e JOIN known k ON e.to_id = k.id LEFT JOIN l_sections s ON s.id = e.from_id WHERE e.kind = 'DEFINES'),
top3 AS (SELECT defs.*, row_number() OVER (PARTITION BY pos ORDER BY weight DESC, path, start_line NULLS FIRST, eid) AS nth FROM defs JOIN l_documents d ON d.id = document_id QUALIFY nth <= 3),
own AS (SELECT section_id, arg_min(content, id) AS content FROM l_chunks WHERE section_id IS NOT NULL GROUP BY section_id),
anyc AS (SELECT document_id, arg_min(content, id) AS content FROM l_chunks GROUP BY document_id),
ch1 AS (SELECT document_id, section_id, coalesce(own.content, anyc.content) AS content, 200 + weight AS base, row_number() OVER (ORDER BY pos, nth) AS rank, 'definition' AS channel, 0 AS o, 'definition of an entity that the query names' AS reason
  FROM top3 LEFT JOIN own USING (section_id) LEFT JOIN anyc USING (document_id)),
best AS (SELECT id, score FROM x_bm25 ORDER BY score DESC, id LIMIT {2 * _LIMIT}),
ch2 AS (SELECT c.document_id, c.section_id, c.content, 100 + score AS base, row_number() OVER (ORDER BY score DESC, c.id) AS rank, 'fts' AS channel, 1 AS o, 'full-text match' AS reason FROM best JOIN l_chunks c USING (id)),
rows0 AS (SELECT * FROM ch1 UNION ALL SELECT * FROM ch2),
rows1 AS (SELECT r.*, d.path, d.title, d.trust_tier, d.status,
  (SELECT list(struct_pack(name := k.name, documents := k.documents) ORDER BY k.pos) FROM known k WHERE contains(lower(r.content), lower(k.name)) OR contains(lower(r.content), k.normalized_name)) AS entities
  FROM rows0 r JOIN l_documents d ON d.id = r.document_id),
rows2 AS (SELECT *, coalesce(section_id, document_id) AS key, coalesce(list_filter(entities, lambda e: e.documents > {_COMMON}), []) AS common FROM rows1),
rows3 AS (SELECT *, base + {_BOOSTS} + CASE WHEN channel <> 'definition' AND len(common) > 0 THEN -least(60, 20 * len(common)) ELSE 0 END AS score0,
  reason || CASE WHEN channel <> 'definition' AND len(common) > 0 THEN '; ranked down for common entities (' || array_to_string(list_transform(common, lambda e: e.name || ' in ' || e.documents || ' documents'), ', ') || ')' ELSE '' END AS why FROM rows2),
fused AS (SELECT key, round(1000 * sum(1.0::DOUBLE / (60 + r)), 4) AS boost, string_agg(channel || '#' || r, ', ' ORDER BY channel) AS how FROM (SELECT key, channel, min(rank) AS r FROM rows3 GROUP BY key, channel) GROUP BY key),
rows4 AS (SELECT rows3.*, round(score0 + boost, 4) AS score, list_append(string_split(why, '; '), 'fused ranks (' || how || ')') AS reasons FROM rows3 JOIN fused USING (key)),
merged AS (SELECT key, max(score) AS score, min(o * 1000000 + rank) AS seq, flatten(list(reasons ORDER BY o, rank)) AS reasons, flatten(list(list_transform(coalesce(entities, []), lambda e: e.name) ORDER BY o, rank)) AS entities,
  arg_min(struct_pack(path := path, content := content, document_id := document_id), struct_pack(s := -score, q := o * 1000000 + rank)) AS d FROM rows4 GROUP BY key)
SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, key AS node_id, d.document_id AS document_id, d.path AS path, anchor, score, d.content AS content,
  array_to_string(list_filter(reasons, lambda x, i: list_position(reasons, x) = i), '; ') AS reason, array_to_string(list_filter(entities, lambda x, i: list_position(entities, x) = i), ',') AS entities
FROM merged LEFT JOIN l_sections s ON s.id = key ORDER BY score DESC, seq LIMIT {_LIMIT}"""


@query(_SEARCH_SQL)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: names of the query, their definitions, full text, boosts, fusion, reasons."""
    run = search.search(library(spark, sf_dir), _QUERY, Config(high_frequency_entity_threshold=_COMMON), _LIMIT)
    names = F.array_join(F.transform("entities", lambda e: e["name"]), ",")
    return run.results.select(F.col("rank").cast("bigint").alias("rank"), "node_id", "document_id", "path", "anchor", "score", "content", "reason", names.alias("entities"))


@query(f"WITH {LIBRARY_SQL}, {_indexed_bm25('l_chunks', 'id', 'content', ('the', 'nicht', 'ouel', 'eau'))} SELECT id, round(score, 6) AS score FROM x_bm25")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the search matches: the indexed stream, folded, over stored postings."""
    g = library(spark, sf_dir)
    stored = fts.postings(g.chunks, "id", "content")
    return fts.bm25_postings(stored, fts.totals(g.chunks, "content"), ["the", "nicht", "ouel", "eau"]).select("id", F.round("score", 6).alias("score"))


vectors.register_provider("axis", lambda model, dimensions: lambda texts: [[1.0 / (1 + i % 7) for i in range(dimensions)] for _ in texts])


def _vector_library(spark: SparkSession, sf_dir: str) -> GraphTables:
    e, none = table(spark, sf_dir, "embeddings"), F.lit(None).cast("string")
    ident = lambda p: F.concat(F.lit(p), F.col("vec_id"))
    g = library(spark, sf_dir)
    docs = e.select(
        ident("v").alias("id"), F.concat(F.lit("set"), "label", F.lit("/"), "vec_id", F.lit(".md")).alias("path"), ident("Vector ").alias("title"), F.lit("spec").alias("type"), F.when(F.col("vec_id") % 3 == 0, "draft").otherwise("active").alias("status"),
        ident("h").alias("hash"), F.when(F.col("vec_id") % 5 == 0, "validated").otherwise("authored").alias("trust_tier"), none.alias("updated_at"), none.alias("indexed_at"), F.array().cast("array<string>").alias("tags"), none.alias("metadata_json"),
    )
    chunks = e.select(ident("c").alias("id"), ident("v").alias("document_id"), none.alias("section_id"), ident("number ").alias("content"), F.lit(1).alias("token_estimate"), none.alias("metadata_json"))
    own = e.select(ident("c").alias("chunk_id"), F.lit("axis").alias("provider"), F.lit("axis-v1").alias("model"), F.lit(64).alias("dimensions"), F.col("embedding").alias("vector"), none.alias("created_at"))
    return replace(g, documents=docs, sections=g.sections.limit(0), entities=g.entities.limit(0), edges=g.edges.limit(0), chunks=chunks, chunk_vectors=own)


@query(
    f"""WITH q AS (SELECT list_transform(range(64), lambda i: 1.0::DOUBLE / (1 + i % 7)) AS v),
s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, q),
t AS (SELECT *, row_number() OVER (ORDER BY sim DESC, 'c' || vec_id) AS rank FROM s WHERE sim > 0 QUALIFY rank <= 16),
d AS (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 'validated' ELSE 'authored' END AS trust_tier, CASE WHEN vec_id % 3 = 0 THEN 'draft' ELSE 'active' END AS status FROM t),
r AS (SELECT *, round(80 + 50 * sim + {_BOOSTS} + round(1000 * (1.0::DOUBLE / (60 + rank)), 4), 4) AS score FROM d)
SELECT 'v' || vec_id AS node_id, 'set' || label || '/' || vec_id || '.md' AS path, score, round(sim, 4) AS similarity, printf('axis vector match (%.3f); fused ranks (semantic#%d)', sim, rank) AS reason
FROM r ORDER BY score DESC, rank LIMIT 8"""
)
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config(semantic=True, provider="axis", embedding_model="axis-v1", dimensions=64)
    run = search.search(_vector_library(spark, sf_dir), "zzz", config, 8, "semantic")
    return run.results.select("node_id", "path", "score", "similarity", "reason")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM documents),
n AS (SELECT doc_id, t, 2 * count(*) AS n FROM w WHERE length(t) > 1 AND t NOT IN ('and', 'or', 'not', 'near') GROUP BY doc_id, t),
f AS (SELECT t, {_FNV.format('t')} % 128 AS dimension, CASE WHEN {_FNV.format("('sign:' || t)")} % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(length(t))) AS x FROM (SELECT DISTINCT t FROM n)),
v AS (SELECT doc_id, dimension, sum(n * x) AS x FROM n JOIN f USING (t) GROUP BY doc_id, dimension),
z AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM v GROUP BY doc_id)
SELECT doc_id, dimension, round(round(x / z, 6)::FLOAT::DOUBLE, 4) AS value FROM v JOIN z USING (doc_id) WHERE abs(round(x / z, 6)::FLOAT) >= 0.001::FLOAT"""
)
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(vectors.embed_column(F.col("text"), "local-hash", "local-hash-v1", 128)).alias("dimension", "x"))
    return rows.where("abs(x) >= 0.001").select("doc_id", F.col("dimension").cast("bigint").alias("dimension"), F.round(F.col("x").cast("double"), 4).alias("value"))


# ----------------------------------------------------------------------- nodes
@query(
    f"""{_WITH}, c AS (SELECT * FROM l_chunks)
SELECT id, 'document' AS kind, title AS label, path, NULL::INT AS line, id AS document_id FROM l_documents UNION ALL SELECT id, 'section', heading, NULL, start_line, document_id FROM l_sections
UNION ALL SELECT id, 'entity', name, NULL, NULL, NULL FROM l_entities UNION ALL SELECT id, 'source_ref', path, path, NULL, NULL FROM l_source_refs UNION ALL SELECT id, 'chunk', id, NULL, NULL, document_id FROM c"""
)
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.all_nodes(library(spark, sf_dir)).drop("order")


@query(f"{_WITH} SELECT document_id, kind, to_id FROM l_edges JOIN l_owners o ON o.id = from_id")
def edge_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.edge_owner(library(spark, sf_dir))


_NODES = ["doc:7", "doc:10", "ent:erreth", "src:en", "doc:0"]


@query(
    f"""{_WITH}, n AS (SELECT unnest({_NODES!r}) AS node),
e AS (SELECT node, e.*, CASE WHEN node = from_id THEN to_id ELSE from_id END AS other FROM n JOIN l_edges e ON node = from_id OR node = to_id WHERE kind <> 'CONTAINS')
SELECT node, other, id, row_number() OVER (PARTITION BY node ORDER BY weight * confidence DESC, weight DESC, confidence DESC, id) AS rank FROM e QUALIFY rank <= 4"""
)
def edges_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.edges_of(library(spark, sf_dir), _NODES, 4, "CONTAINS").select("node", "other", "id", F.col("rank").cast("bigint").alias("rank"))


_PLACES = ["doc:7", "sec:10:0", "chunk:0:0", "sec:0:3", "doc:3", "ent:erreth"]


@query(
    f"""{_WITH}, n AS (SELECT unnest({_PLACES!r}) AS node),
p AS (SELECT id AS node, 0 AS o, id, document_id, section_id, content FROM l_chunks UNION ALL SELECT section_id, 1, id, document_id, section_id, content FROM l_chunks UNION ALL SELECT document_id, 2, id, document_id, section_id, content FROM l_chunks)
SELECT node AS node_id, p.id AS chunk_id, p.document_id, p.section_id, d.path, p.content AS chunk_content, s.start_line
FROM n JOIN p USING (node) LEFT JOIN l_sections s ON s.id = p.section_id JOIN l_documents d ON d.id = p.document_id QUALIFY row_number() OVER (PARTITION BY node ORDER BY o, s.start_line NULLS FIRST, p.id) = 1"""
)
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.context_chunks(library(spark, sf_dir), _PLACES).select("node_id", "chunk_id", "document_id", "section_id", "path", "chunk_content", "start_line")


_LOOKUPS = ["doc:5", " text 12 ", "src/EN.ts", "ERRETH", "doc:nowhere", "Line 1"]


@query(
    f"""{_WITH}, q AS (SELECT unnest({_LOOKUPS!r}) AS q),
t AS (SELECT q, 0 AS tier, id, 'document' AS kind FROM q JOIN l_documents ON id = trim(q) UNION ALL SELECT q, 20, id, 'document' FROM q JOIN l_documents ON lower(title) = lower(trim(q)) OR lower(path) = lower(trim(q))
  UNION ALL SELECT q, 30, id, 'source_ref' FROM q JOIN l_source_refs ON lower(path) = lower(trim(q)) UNION ALL SELECT q, 40, id, 'section' FROM q JOIN l_sections ON lower(heading) = lower(trim(q)) OR anchor = replace(lower(trim(q)), ' ', '-')
  UNION ALL SELECT q, 50, id, 'entity' FROM q JOIN l_entities ON normalized_name = lower(trim(q))),
b AS (SELECT q, min(tier) AS tier FROM t GROUP BY q), n AS (SELECT q, tier, count(*) AS n, min(id) AS id, min(kind) AS kind FROM t JOIN b USING (q, tier) GROUP BY q, tier)
SELECT q AS query, CASE WHEN n.n IS NULL THEN 'not_found' WHEN n.tier = 40 AND n.n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n.tier = 40 AND n.n > 1 THEN NULL ELSE n.id END AS id, CASE WHEN n.tier = 40 AND n.n > 1 THEN NULL ELSE n.kind END AS kind
FROM q LEFT JOIN n USING (q)"""
)
def node_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = library(spark, sf_dir)
    found = [nodes.resolve_node(g, q) for q in _LOOKUPS]
    return spark.createDataFrame([(r.query, r.status, r.node and r.node["id"], r.node and r.node["kind"]) for r in found], "query string, status string, id string, kind string")


@query(
    f"""{_WITH},
o AS (SELECT document_id, kind, to_id FROM l_edges JOIN l_owners o ON o.id = from_id),
named AS (SELECT id, lower(name) AS t FROM l_entities UNION SELECT id, lower(id) FROM l_entities),
hit AS (SELECT DISTINCT document_id FROM o JOIN named n ON n.id = o.to_id WHERE kind = 'DEFINES' AND contains(n.t, 'er')),
miss AS (SELECT DISTINCT document_id FROM o WHERE kind = 'REFERENCES_SOURCE')
SELECT d.id, path FROM l_documents d SEMI JOIN hit ON d.id = hit.document_id WHERE d.id NOT IN (SELECT document_id FROM miss) AND d.status <> 'draft'"""
)
def dsl_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter language over the owners and names of the nodes that edges lead to."""
    g = library(spark, sf_dir)
    return dsl.execute('edge.DEFINES ~ "er" AND edge != REFERENCES_SOURCE AND status != draft', g.documents, edge_owner=nodes.edge_owner(g), node_text=nodes.node_text(g))[0].select("id", "path")


# ------------------------------------------------------------- paths and links
@query(
    f"""WITH RECURSIVE {LIBRARY_SQL}, k AS (SELECT id, from_id, to_id, weight, confidence FROM l_edges WHERE kind IN ('LINKS_TO', 'RELATED_TO')),
b AS (SELECT from_id AS x, to_id AS y, -weight AS w, -confidence AS c, id AS edge FROM k UNION ALL SELECT to_id, from_id, -weight, -confidence, id FROM k),
p AS (SELECT y, 1 AS depth, [struct_pack(w := w, c := c, edge := edge, a := x, b := y)] AS path FROM b WHERE x = 'doc:8'
  UNION ALL SELECT b.y, depth + 1, list_append(path, struct_pack(w := b.w, c := b.c, edge := b.edge, a := b.x, b := b.y)) FROM p JOIN b ON b.x = p.y WHERE depth < 6 AND NOT list_contains(list_transform(path, lambda s: s.a), b.y)),
one AS (SELECT path FROM p WHERE y = 'doc:18' ORDER BY depth, path LIMIT 1)
SELECT i AS step, path[i].a AS a, path[i].b AS b, path[i].edge AS edge FROM one, range(1, 8) t(i) WHERE i <= len(path)"""
)
def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path between two documents that a trace shows."""
    edges = library(spark, sf_dir).edges.where("kind IN ('LINKS_TO', 'RELATED_TO')")
    path = graph.shortest_path(edges, "doc:8", "doc:18", 6) or []
    return spark.createDataFrame([(i, s["a"], s["b"], s["edge"]) for i, s in enumerate(path, 1)], "step bigint, a string, b string, edge string")


def _pages_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as parsed files: path, title, sections with anchors and headings."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.regexp_replace(F.regexp_extract("url", "^https?://[^/?#]*/?([^?#]*)", 1), "/$", ""), F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".MDX"))
    s = lambda i: F.struct(F.concat(F.lit(f"s{i}:"), "page_id").alias("id"), F.lit(f"a{i}").alias("anchor"), F.lit(f"Part No. {i}!").alias("heading"))
    return p.select(F.concat(F.lit("page:"), "page_id").alias("id"), path.alias("path"), F.concat(F.lit("Title "), F.col("page_id") % 40).alias("title"), F.struct(F.lit(None).cast("string").alias("id")).alias("front"), F.array(s(0), s(1)).alias("sections"))


_PAGES_SQL = """pg AS (SELECT page_id, 'page:' || page_id AS id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1), '/$', '') AS stem, 'Title ' || page_id % 40 AS title FROM pages),
al AS (SELECT DISTINCT alias, id FROM (SELECT id, lower(stem) AS alias FROM pg UNION ALL SELECT id, lower(regexp_extract(stem, '[^/]*$')) FROM pg UNION ALL SELECT id, lower(title) FROM pg) WHERE alias <> ''),
one AS (SELECT alias, min(id) AS target FROM al GROUP BY alias HAVING count(DISTINCT id) = 1)"""


@query(
    f"""WITH {_PAGES_SQL},
hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
r AS (SELECT 'page:' || page_id AS from_id, string_split(href, '#')[1] AS ref, CASE (page_id + length(href)) % 4 WHEN 0 THEN 'a1' WHEN 1 THEN 'Part No 0' WHEN 2 THEN 'none' END AS anchor FROM hrefs WHERE NOT contains(href, '..') AND NOT contains(href, '//')),
k AS (SELECT *, regexp_replace(lower(trim(ref, '/')), '\\.mdx?$', '') AS key FROM r WHERE ref = '' OR starts_with(ref, '/') OR NOT contains(ref, '/')),
t AS (SELECT k.*, CASE WHEN key <> '' THEN target WHEN anchor IS NOT NULL THEN from_id END AS target_id FROM k LEFT JOIN one ON alias = key AND key <> '')
SELECT from_id, ref, anchor, CASE WHEN anchor IS NULL THEN target_id WHEN anchor = 'a1' AND target_id IS NOT NULL THEN 's1:' || substr(target_id, 6) WHEN anchor = 'Part No 0' AND target_id IS NOT NULL THEN 's0:' || substr(target_id, 6) END AS node_id, count(*) AS n
FROM t GROUP BY ALL"""
)
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved by aliases and anchors."""
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    hrefs = hrefs.where(~F.col("href").contains("..") & ~F.col("href").contains("//"))
    ref = F.split("href", "#")[0]
    kind = (F.col("page_id") + F.length("href")) % 4
    anchor = F.when(kind == 0, "a1").when(kind == 1, "Part No 0").when(kind == 2, "none")
    refs = hrefs.select(F.concat(F.lit("page:"), "page_id").alias("from_id"), F.concat(F.lit("page-"), "page_id").alias("from_path"), ref.alias("ref"), anchor.alias("anchor"))
    refs = refs.where((F.col("ref") == "") | F.col("ref").startswith("/") | ~F.col("ref").contains("/"))
    return resolve.resolve(refs, _pages_parsed(spark, sf_dir)).groupBy("from_id", "ref", "anchor", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim('  ' || p_name || ' – ' || p_type || ' `' || p_brand || '` 中文! ')), '`', ''), '[^a-z0-9\\x{4e00}-\\x{9fff}\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section') AS slug FROM part"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat(F.lit("  "), "p_name", F.lit(" – "), "p_type", F.lit(" `"), "p_brand", F.lit("` 中文! "))
    return table(spark, sf_dir, "part").select("p_partkey", tx.slugify(heading).alias("slug"))


# ------------------------------------------------------- health and difference
@query(
    f"""{_WITH}, plain AS (SELECT * FROM l_edges WHERE kind <> 'CONTAINS' AND provenance <> 'embedding_similarity'),
sc AS (SELECT d.id AS document_id, s.id AS s, c.id AS c FROM l_documents d LEFT JOIN l_sections s ON s.document_id = d.id LEFT JOIN l_chunks c ON c.document_id = d.id),
touched AS (SELECT DISTINCT o.document_id, e.id, e.from_id, e.to_id, e.kind FROM plain e JOIN l_owners o ON o.id IN (e.from_id, e.to_id)),
raw AS (SELECT t.document_id, count(*) AS raw, count(DISTINCT t.id) AS exact, count(*) FILTER (kind = 'DEFINES') AS definitions FROM touched t JOIN sc USING (document_id)
  WHERE from_id IN (t.document_id, s, c) OR to_id IN (t.document_id, s, c) GROUP BY t.document_id)
SELECT f.document_id, coalesce(raw, 0) AS raw, coalesce(exact, 0) AS exact, coalesce(definitions, 0) AS definitions FROM (SELECT id AS document_id FROM l_documents) f LEFT JOIN raw USING (document_id)"""
)
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.document_links(library(spark, sf_dir)).select("document_id", "raw", "exact", "definitions")


_TOUCHED = f"""{_WITH}, plain AS (SELECT * FROM l_edges WHERE kind <> 'CONTAINS' AND provenance <> 'embedding_similarity'),
lines AS (SELECT n, count(*) AS k FROM l_lines GROUP BY n),
touched AS (SELECT DISTINCT o.document_id, e.id, e.kind, o.id AS end FROM plain e JOIN l_owners o ON o.id IN (e.from_id, e.to_id)),
per AS (SELECT document_id, count(DISTINCT touched.id) AS edges, count(*) FILTER (kind = 'DEFINES') AS defs, bool_and(k = 1 OR starts_with("end", 'sec')) AS once, max(k) AS k FROM touched JOIN l_documents d ON d.id = document_id JOIN lines USING (n) GROUP BY document_id)"""


@query(f"{_TOUCHED} SELECT path FROM l_documents d ANTI JOIN per ON per.document_id = d.id")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.orphans(health.document_links(library(spark, sf_dir))).select("path")


@query(f"{_TOUCHED} SELECT path FROM l_documents d JOIN per ON per.document_id = d.id WHERE edges = 1 AND k = 1")
def weakly_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one line with one edge: in longer ones it counts once for each pair of a section and a chunk."""
    return health.weakly_linked(health.document_links(library(spark, sf_dir))).select("path")


@query(f"{_TOUCHED} SELECT path FROM l_documents d LEFT JOIN per ON per.document_id = d.id WHERE type IN ('design', 'adr', 'api', 'runbook', 'spec') AND coalesce(defs, 0) = 0")
def missing_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.missing_definitions(health.document_links(library(spark, sf_dir))).select("path")


@query(
    f"""{_WITH}, d AS (SELECT e.to_id AS entity_id, list_sort(list(DISTINCT d.path)) AS paths FROM l_edges e JOIN l_owners o ON o.id = e.from_id JOIN l_documents d ON d.id = o.document_id
  WHERE kind = 'DEFINES' AND status = 'active' GROUP BY e.to_id HAVING count(DISTINCT d.path) > 1)
SELECT name, array_to_string(paths, ' ') AS paths FROM d JOIN l_entities n ON n.id = entity_id WHERE normalized_name NOT IN ('thing', 'nicht')"""
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = health.contradictions(library(spark, sf_dir), Config(stop_entities=("Thing", "Nicht")))
    return found.select("name", F.array_join("paths", " ").alias("paths"))


@query(
    f"""{_WITH}, c AS (SELECT document_id AS id, count(*) AS chunks, sum(length(content)) AS chars FROM l_chunks GROUP BY 1)
SELECT split_part(path, '/', 1) AS path_group, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(strlen(path) + chars)::BIGINT AS content_bytes FROM l_documents JOIN c USING (id) GROUP BY 1"""
)
def path_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.path_groups(library(spark, sf_dir))


@query(
    f"""{_WITH}, x AS (SELECT unnest([from_id, to_id]) AS id FROM l_edges WHERE kind <> 'CONTAINS'), t AS (SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 10),
k AS (SELECT id, 'document' AS kind, title AS label FROM l_documents UNION ALL SELECT id, 'entity', name FROM l_entities UNION ALL SELECT id, 'source_ref', path FROM l_source_refs UNION ALL SELECT id, 'section', heading FROM l_sections)
SELECT t.*, kind, label FROM t JOIN k USING (id)"""
)
def high_degree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.high_degree(library(spark, sf_dir))


@query(
    f"""{_WITH}, x AS (SELECT unnest([from_id, to_id]) AS id FROM l_edges WHERE kind <> 'CONTAINS'), t AS (SELECT id, count(*) AS degree FROM x GROUP BY id ORDER BY degree DESC, id LIMIT 10)
SELECT 'storage.high_degree_node' AS code, coalesce(r.path, e.name) AS label, degree FROM t LEFT JOIN l_source_refs r USING (id) LEFT JOIN l_entities e USING (id) WHERE degree >= 50
UNION ALL SELECT 'storage.vector_anomaly', 'vectors', (SELECT count(*) FROM l_chunks)"""
)
def storage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs, and an index with vectors for a part of its chunks."""
    g = library(spark, sf_dir)
    g = replace(g, chunk_vectors=g.chunks.where("id LIKE '%:0'").select(F.col("id").alias("chunk_id")))
    n = F.coalesce(F.get_json_object("evidence", "$.degree"), F.get_json_object("evidence", "$.chunks")).cast("bigint")
    return health.storage_warnings(g).select("code", "label", n.alias("degree"))


_PARSED_SQL = """p AS (SELECT path, CASE WHEN n % 13 = 0 THEN id || '-moved' ELSE id END AS id, CASE WHEN n % 11 = 0 THEN hash || 'x' ELSE hash END AS hash, n % 17 = 0 AS failed FROM l_documents WHERE n % 7 <> 0
  UNION ALL SELECT 'new/' || n || '.md', 'new:' || n, hash, false FROM l_documents WHERE n % 50 = 3)"""


@query(
    f"""{_WITH}, {_PARSED_SQL},
b AS (SELECT coalesce(p.path, d.path) AS path, p.id AS i1, d.id AS i0, p.hash AS h1, d.hash AS h0, failed FROM p FULL JOIN l_documents d ON p.path = d.path)
SELECT path, CASE WHEN i0 IS NULL THEN 'added' WHEN i1 IS NULL THEN 'deleted' WHEN i0 <> i1 THEN 'id_changed' ELSE 'modified' END AS reason FROM b WHERE NOT coalesce(failed, false) AND (i0 IS NULL OR i1 IS NULL OR i0 <> i1 OR h0 <> h1)"""
)
def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = library(spark, sf_dir)
    n = F.substring_index("id", ":", -1).cast("int")
    d = g.documents.withColumn("n", n)
    p = d.where("n % 7 <> 0").select(
        "path", F.when(F.col("n") % 13 == 0, F.concat("id", F.lit("-moved"))).otherwise(F.col("id")).alias("id"), F.when(F.col("n") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"),
        F.when(F.col("n") % 17 == 0, "broken").alias("error"),
    )
    new = d.where("n % 50 = 3").select(F.concat(F.lit("new/"), "n", F.lit(".md")), F.concat(F.lit("new:"), "n"), "hash", F.lit(None).cast("string"))
    return health.stale_index(p.union(new), g.documents).select("path", "reason")


@query(
    f"""{_WITH}, base AS (SELECT path, id FROM l_documents ORDER BY id LIMIT 5),
own AS (SELECT o.id FROM l_owners o JOIN base b ON o.document_id = b.id), e AS (SELECT from_id AS a, to_id AS b FROM l_edges UNION ALL SELECT to_id, from_id FROM l_edges)
SELECT path FROM base UNION SELECT path FROM e JOIN own ON e.a = own.id JOIN l_owners o ON o.id = e.b JOIN l_documents d ON d.id = o.document_id"""
)
def scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a change and those an edge away."""
    g = library(spark, sf_dir)
    first = tuple(r["path"] for r in g.documents.orderBy("id").select("path").limit(5).collect())
    return health.scope_paths(g, health.Scope("changed", changed=first))


def _base(g: GraphTables) -> GraphTables:
    """The library as it was: fewer documents and sections, other hashes and states, another source file."""
    n = F.substring_index("id", ":", -1).cast("int")
    docs = g.documents.withColumn("n", n).where("n % 9 <> 4")
    docs = docs.withColumn("hash", F.when(F.col("n") % 8 == 0, F.lit("old")).otherwise(F.col("hash"))).withColumn("status", F.when(F.col("n") % 21 == 5, F.lit("draft")).otherwise(F.col("status")))
    refs = g.source_refs.select(F.regexp_replace("id", "en$", "xx").alias("id"), F.regexp_replace("path", "EN", "XX").alias("path"), "normalized_path", "created_at", "metadata_json")
    return replace(g, documents=docs.drop("n"), sections=g.sections.where("start_line <= 12"), source_refs=refs)


@query(
    f"""{_WITH}, a AS (SELECT n, id, path, CASE WHEN n % 8 = 0 THEN 'old' ELSE hash END AS hash, CASE WHEN n % 21 = 5 THEN 'draft' ELSE status END AS status FROM l_documents WHERE n % 9 <> 4),
k AS (SELECT n, count(*) FILTER (i < 12) AS sa, count(*) AS sb FROM l_sections GROUP BY n),
r AS (SELECT 'doc:' || n AS id, (lang <> 'en')::INT AS ra, 1 AS rb FROM l_raw WHERE n % 5 = 2)
SELECT b.path, CASE WHEN a.id IS NULL THEN 'added' ELSE 'modified' END AS change, coalesce(a.hash <> b.hash, true) AS hash_changed, a.status <> b.status AS status_changed,
  (sb - CASE WHEN a.id IS NULL THEN 0 ELSE sa END)::BIGINT AS section_delta, (coalesce(rb, 0) - CASE WHEN a.id IS NULL THEN 0 ELSE coalesce(ra, 0) END)::BIGINT AS source_ref_delta
FROM l_documents b LEFT JOIN a USING (id) JOIN k ON k.n = b.n LEFT JOIN r ON r.id = b.id WHERE a.id IS NULL OR a.hash <> b.hash OR a.status <> b.status"""
)
def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = library(spark, sf_dir)
    return diff.diff_documents(_base(g), g).drop("previous_path")


@query(f"{_WITH} SELECT 'ref' AS what, 'src/XX.ts' AS name, 0 AS n UNION ALL SELECT 'ref', 'src/EN.ts', 0 UNION ALL SELECT 'sections', '', (SELECT count(*) FILTER (i >= 12) FROM l_sections)")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files on one side only, and how many more sections there are."""
    g = library(spark, sf_dir)
    found = diff.graph_diff(_base(g), g)
    refs = found.source_refs.select(F.lit("ref").alias("what"), F.col("path").alias("name"), F.lit(0).alias("n"))
    return refs.union(spark.createDataFrame([("sections", "", found.deltas["sections"])], "what string, name string, n int"))


@query(
    """WITH e AS (SELECT event_type AS code, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS x FROM events)
SELECT code, sum(x)::BIGINT AS delta FROM e GROUP BY code HAVING sum(x) <> 0"""
)
def warning_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "event_id")
    return diff.count_delta(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "code")


@query(f"{_WITH} " + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM l_{t}" for t in ("documents", "sections", "entities", "source_refs", "edges", "chunks")) + " UNION ALL SELECT 'chunk_vectors', 0")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(counts(library(spark, sf_dir)).items()), "name string, n bigint")


@query(f"{_WITH} SELECT id, from_id, to_id, kind FROM l_edges WHERE to_id IN (SELECT id FROM l_documents UNION ALL SELECT id FROM l_sections UNION ALL SELECT id FROM l_entities UNION ALL SELECT id FROM l_source_refs)")
def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.structural_edges(library(spark, sf_dir)).select("id", "from_id", "to_id", "kind")


@query(
    f"""{_WITH}, n AS (SELECT 0 AS k, [path, id] AS sort, id FROM l_documents UNION ALL SELECT 1, [path, lpad(start_line::VARCHAR, 10, '0'), s.id], s.id FROM l_sections s JOIN l_documents d ON d.id = document_id
UNION ALL SELECT 2, [kind, normalized_name, id], id FROM l_entities UNION ALL SELECT 3, [path, id], id FROM l_source_refs)
SELECT k, array_to_string(sort, '|') AS sort, id FROM n"""
)
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what the nodes of an export are sorted."""
    return export.structural_nodes(library(spark, sf_dir)).select("k", F.array_join("sort", "|").alias("sort"), "id")


@query(
    f"""{_WITH}, own AS (SELECT id, id AS doc FROM l_documents UNION ALL SELECT id, document_id FROM l_sections),
e AS (SELECT kind, f.doc AS f, t.doc AS t, to_id FROM l_edges JOIN own f ON f.id = from_id LEFT JOIN own t ON t.id = to_id),
de AS (SELECT f AS id, list_sort(list(DISTINCT name)) AS x FROM e JOIN l_entities n ON n.id = to_id WHERE e.kind = 'DEFINES' GROUP BY f),
sr AS (SELECT f AS id, list_sort(list(DISTINCT path)) AS x FROM e JOIN l_source_refs n ON n.id = to_id WHERE e.kind = 'REFERENCES_SOURCE' GROUP BY f),
ob AS (SELECT f AS id, list_sort(list(DISTINCT path)) AS x FROM e JOIN l_documents d ON d.id = t WHERE f <> t GROUP BY f), ib AS (SELECT t AS id, list_sort(list(DISTINCT path)) AS x FROM e JOIN l_documents d ON d.id = f WHERE f <> t GROUP BY t),
j AS (SELECT d.path, d.title, coalesce(array_to_string(de.x, ' '), '') AS defines, coalesce(array_to_string(sr.x, ' '), '') AS source_refs, coalesce(array_to_string(ob.x, ' '), '') AS outbound, coalesce(array_to_string(ib.x, ' '), '') AS inbound
FROM l_documents d LEFT JOIN de USING (id) LEFT JOIN sr USING (id) LEFT JOIN ob USING (id) LEFT JOIN ib USING (id))
SELECT * FROM j"""
)
def docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = export.docs_index(library(spark, sf_dir))
    return got.select("path", "title", *[F.array_join(c, " ").alias(c) for c in ("defines", "source_refs", "outbound", "inbound")])


@query(
    r"""WITH a AS (SELECT DISTINCT lower(regexp_replace(replace(x, chr(92), '/'), '^\./', '')) AS k, regexp_replace(replace(x, chr(92), '/'), '^\./', '') AS p FROM (VALUES ('./src/en.ts'), ('SRC\de.ts'), ('src/none.ts')) v(x)),
r AS (SELECT DISTINCT 'src/' || upper(lang) || '.ts' AS path, 'src/' || lang || '.ts' AS k FROM documents)
SELECT r.path AS source_ref, p AS artifact_path FROM r LEFT JOIN a USING (k)"""
)
def source_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of another tool's artifact the source references are."""
    artifact = spark.createDataFrame([("./src/en.ts", None), ("SRC\\de.ts", None), ("src/none.ts", None)], "path string, symbols array<struct<name: string, kind: string>>")
    hit, missing = export.source_bridge(library(spark, sf_dir), artifact)
    return hit.select("source_ref", "artifact_path").union(missing.select("source_ref", F.lit(None).cast("string")))


# ------------------------------------------------------ extraction and streams
@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_split_to_array(html, '
?
')) AS t, generate_subscripts(regexp_split_to_array(html, '
?
'), 1) AS line FROM pages),
r AS (SELECT page_id, line, unnest(list_filter([
  CASE WHEN contains(lower(t), 'ignore previous instructions') OR contains(lower(t), 'system prompt') THEN 'possible prompt injection text' END,
  CASE WHEN regexp_matches(t, '(?i)<\s*(?:script|iframe)(?:[^A-Za-z0-9_]|$)') THEN 'HTML script or iframe' END,
  CASE WHEN regexp_matches(t, '(?i)data:(?:text/html|application/javascript)') THEN 'active data URI' END,
  CASE WHEN regexp_matches(t, '\p{Cf}') THEN 'hidden Unicode format character' END], lambda x: x IS NOT NULL)) AS reason FROM l)
SELECT page_id AS id, line, reason FROM r"""
)
def content_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.content_risks(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("line", F.col("line").cast("bigint"))


_NAME_FORMS = "[w, w || 'Error', 'ERR_' || upper(w), '/' || w || '/x', 'src/' || w || '.py', 'npm run ' || w, upper(w) || '_1', w || '.a.b', 'GET /' || w, '@' || w || '/pkg', 'ADR-12', '`' || w || '`', w || '()', w || ';']"


@query(
    rf"""WITH w AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]{{4,}}') AS w FROM documents), x AS (SELECT DISTINCT unnest({_NAME_FORMS}) AS name FROM w WHERE w <> ''),
c AS (SELECT name, regexp_replace(regexp_replace(trim(name), '^`|`$', '', 'g'), '[.,;:]$', '') AS cleaned, trim(name) AS n FROM x)
SELECT name, cleaned, lower(regexp_replace(n, '^`|`$', '', 'g')) AS normal,
CASE WHEN regexp_matches(n, '^(?:(?:GET|POST|PUT|PATCH|DELETE)\s+)?/[\p{{L}}\p{{N}}_./:{{}}-]+$') THEN 'api_route'
 WHEN regexp_matches(' ' || n, '(?:^|\s)[\p{{L}}\p{{N}}_@.-]+/[\p{{L}}\p{{N}}_@./-]+\.(?:ts|tsx|js|jsx|md|mdx|json|yaml|yml|toml|rs|go|py|java|cs|sql)') THEN 'file_path'
 WHEN regexp_matches(n, '^(?:npm|pnpm|yarn|go|cargo|docker|kubectl|node|npx)\s+') THEN 'command'
 WHEN regexp_matches(n, '(?:^|[^A-Za-z0-9_])(?:[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{{3,}}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*)(?:[^A-Za-z0-9_]|$)') THEN 'error_code'
 WHEN regexp_matches(n, '^(?:[A-Z][A-Z0-9_]{{2,}}|[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){{2,}})$') THEN 'config_key'
 WHEN regexp_matches(n, '^@?[a-z0-9_.-]+/[a-z0-9_.-]+$') THEN 'package' WHEN regexp_matches(n, '(?i)^ADR-?\d+$') THEN 'decision' ELSE 'symbol' END AS kind FROM c"""
)
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("w")).where("w <> ''").distinct()
    forms = "array" + _NAME_FORMS.replace("[", "(", 1)[:-1] + ")"
    name = F.col("name")
    return w.select(F.explode(F.expr(forms)).alias("name")).distinct().select("name", extract.clean(name).alias("cleaned"), extract.normal(name).alias("normal"), extract.kind_of(name).alias("kind"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events FROM s GROUP BY user_id, session"""
)
def change_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes, as the stream groups them."""
    return watch.change_sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours", "1 day")


@query(
    """SELECT user_id, date_trunc('day', ts) AS day, arg_max(event_type, ts) AS last, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN arg_max(event_type, ts) = 'error' THEN 'degraded' ELSE 'healthy' END AS state
FROM events GROUP BY user_id, date_trunc('day', ts)"""
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = watch.latest_state(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", "1 day", "1 day")
    return got.select("user_id", F.col("w.start").alias("day"), "last", "errors", "state")


# ------------------------------------------------------------------ evaluation
@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000),
n AS (SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM a) AS actual, (SELECT count(*) FROM e SEMI JOIN a USING (k)) AS hits)
SELECT round(hits / actual, 4) AS precision, round(hits / expected, 4) AS recall, expected, actual, hits FROM n"""
)
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evaluate.set_metrics(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000"), ["o_custkey"])


@query(
    """WITH r AS (SELECT l_suppkey AS query, l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem),
t AS (SELECT DISTINCT query, id FROM r WHERE rank <= 5), x AS (SELECT DISTINCT l_suppkey AS query, l_partkey AS id FROM lineitem WHERE l_quantity >= 49)
SELECT query, round(avg((t.id IS NOT NULL)::INT), 4) AS recall FROM x LEFT JOIN t USING (query, id) GROUP BY query"""
)
def recall_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import top_per_group

    line = table(spark, sf_dir, "lineitem")
    ranked = top_per_group(line, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 8)
    pair = [F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("id")]
    return evaluate.recall_at(ranked.select(*pair, "rank"), line.where("l_quantity >= 49").select(*pair), 5)


@query(f"WITH j AS ({ORACLES['jaccard_pairs']}) SELECT round(avg(jaccard), 4) AS average, round(max(jaccard), 4) AS maximum, count(*) FILTER (jaccard >= 0.1) AS near_duplicates FROM j")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the 20 best results of a search are."""
    from .catalog import best_items

    return evaluate.packing_redundancy(best_items(spark, sf_dir), "doc_id", "tokens", 0.1)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of an agent."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    chars = (F.round(F.abs("value") * 10)).cast("double")
    return e.select(
        F.concat(F.lit("r"), n).alias("id"), F.concat(F.lit("q"), F.floor(n / 2)).alias("questionId"), F.concat(F.lit(" ask "), F.when(n % 14 == 3, n).otherwise(F.floor(n / 2))).alias("question"),
        F.when((n % 2 == 0) | (n % 22 == 1), "with_graph").otherwise("without_graph").alias("mode"),
        F.array_repeat(F.struct(F.lit("search").alias("name"), chars.alias("outputChars")), (n % 4).cast("int")).alias("toolCalls"),
        F.array_repeat(F.struct(F.lit("a.md").alias("path"), (chars + 1).alias("chars")), (n % 3).cast("int")).alias("directFileReads"),
        F.array_repeat(F.struct(F.lit("x").alias("query"), (n % 5).cast("double").alias("resultCount")), (n % 2).cast("int")).alias("textSearches"),
        F.array(F.struct(F.lit("g").alias("tool"), F.lit("x").alias("query"), F.lit(2.0).alias("resultCount"), chars.alias("chars"))).alias("graphCalls"),
        F.array(F.struct(F.concat(F.lit("./d"), n % 7, F.lit(".md")).alias("path"), F.lit(1).alias("line"), F.lit(None).cast("boolean").alias("correct")), F.struct(F.lit("z\\y.md").alias("path"), F.lit(2).alias("line"), (n % 3 == 0).alias("correct"))).alias("finalCitations"),
        (n % 5 == 0).alias("rawFileFallback"), (n % 100).cast("double").alias("tokenEstimate"), (n % 13).cast("double").alias("latencyMs"),
    )


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    q = table(spark, sf_dir, "events").where("event_id % 6 = 0")
    return q.select(F.concat(F.lit("q"), F.floor(n / 2)).alias("questionId"), F.array(F.lit("d0.md"), F.lit("d3.md"), F.lit("z/y.md")).alias("paths"))


_RUNS_SQL = """e AS (SELECT event_id AS n, round(abs(value) * 10) AS chars FROM events), x AS (SELECT DISTINCT event_id // 2 AS q FROM events WHERE event_id % 6 = 0),
b AS (SELECT e.*, n // 2 AS q, x.q IS NOT NULL AS judged, n % 7 IN (0, 3) AS hit FROM e LEFT JOIN x ON x.q = n // 2),
m AS (SELECT 'r' || n AS id, 'q' || q AS questionId, 'ask ' || CASE WHEN n % 14 = 3 THEN n ELSE q END AS question, CASE WHEN n % 2 = 0 OR n % 22 = 1 THEN 'with_graph' ELSE 'without_graph' END AS mode,
  n % 4 AS tool_calls, (n % 4) * chars AS tool_chars, n % 3 AS file_reads, (n % 3) * (chars + 1) AS file_chars, n % 2 AS text_searches, (n % 2) * (n % 5)::DOUBLE AS text_results, 1 AS graph_calls, chars AS graph_chars, 2.0::DOUBLE AS graph_results,
  (n % 100)::DOUBLE AS tokenEstimate, (n % 13)::DOUBLE AS latencyMs, (n % 5 = 0)::INT AS fallback,
  CASE WHEN judged THEN 1 + hit::INT ELSE (n % 3 = 0)::INT END AS correct, CASE WHEN judged THEN (NOT hit)::INT ELSE (n % 3 <> 0)::INT END AS incorrect, CASE WHEN judged THEN 0 ELSE 1 END AS unknown FROM b),
r AS (SELECT *, round(correct / (correct + incorrect), 4) AS citation_rate FROM m)"""


@query(f"WITH {_RUNS_SQL} SELECT * FROM r")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_metrics(_runs(spark, sf_dir), _expected(spark, sf_dir))


_PAIRS_SQL = f"""{_RUNS_SQL}, g AS (SELECT questionId, count(DISTINCT question) AS texts, count(*) FILTER (mode = 'with_graph') AS w, count(*) FILTER (mode = 'without_graph') AS o FROM r GROUP BY questionId),
ok AS (SELECT questionId FROM g WHERE texts = 1 AND w = 1 AND o = 1),
p AS (SELECT a.questionId, a.question, {', '.join(f'round(a.{m} - b.{m}, 4) AS {m}' for m in evaluate.MEASURES)} FROM r a JOIN r b USING (questionId) SEMI JOIN ok USING (questionId) WHERE a.mode = 'with_graph' AND b.mode = 'without_graph')"""


@query(f"WITH {_PAIRS_SQL} SELECT * FROM p")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_runs(run_metrics(spark, sf_dir))[0]


@query(
    f"""WITH {_PAIRS_SQL} SELECT questionId, CASE WHEN texts > 1 THEN 'question_text_mismatch' ELSE printf('one run of each mode is needed, not %d with and %d without', w, o) END AS reason FROM g WHERE texts <> 1 OR w <> 1 OR o <> 1"""
)
def runs_passed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_runs(run_metrics(spark, sf_dir))[1].select("questionId", "reason")


_WHOLE = dict.fromkeys(("tool_calls", "file_reads", "text_searches", "graph_calls", "fallback", "unknown"), "::BIGINT")


@query(f"WITH {_PAIRS_SQL} SELECT count(*) AS pairs, {', '.join(f'sum({m}){_WHOLE.get(m, "")} AS {m}' for m in evaluate.MEASURES if m != 'citation_rate')}, round(avg(citation_rate), 4) AS citation_rate FROM p")
def total_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.total_difference(paired_runs(spark, sf_dir))


# --------------------------------------------------------------------- context
@query(
    f"""{_WITH}, {_indexed_bm25("l_chunks", "id", "content", ("the", "nicht", "que"))}, best AS (SELECT id, round(score, 4) AS score FROM x_bm25 ORDER BY score DESC, id LIMIT 100),
x AS (SELECT c.id, d.path, score, n % 3 = 0 AS direct FROM best JOIN l_chunks c USING (id) JOIN l_documents d USING (n)),
t AS (SELECT *, row_number() OVER (PARTITION BY direct, path ORDER BY score DESC, id) AS turn FROM x),
f AS (SELECT *, min(struct_pack(s := -score, id := id)) OVER (PARTITION BY direct, path) AS seen FROM t)
SELECT row_number() OVER (ORDER BY direct DESC, turn, seen) AS position, id FROM f"""
)
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a context takes the 100 best results of a search: documents in turns, direct hits first."""
    g = library(spark, sf_dir)
    best = fts.bm25(g.chunks, "id", "content", ["the", "nicht", "que"], indexed=True).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "id").limit(100)
    rows = best.join(g.chunks, "id").join(g.documents.select(F.col("id").alias("document_id"), "path"), "document_id").orderBy("id").collect()
    items = [context.Candidate(r["id"], r["document_id"], r["path"], "", r["content"], r["score"], int(r["document_id"][4:]) % 3 == 0, "") for r in rows]
    return spark.createDataFrame([(i, c.node_id) for i, c in enumerate(context.interleave(items), 1)], "position bigint, id string")


@query(
    r"""WITH x AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM documents WHERE length(text) > 0),
r AS (SELECT *, 50000 - used AS room FROM x WHERE used < 50000)
SELECT doc_id, CASE WHEN length(text) <= room THEN text WHEN room <= 3 THEN substr(text, 1, room) ELSE regexp_replace(substr(text, 1, room - 3), '\s+$', '') || '...' END AS content FROM r"""
)
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits a budget of 50000 characters, the text that crosses it cut."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").withColumn("n", F.length("text"))
    order, budget, most = [F.col("doc_id").asc_nulls_last(), F.col("n")], 50_000, 500
    while True:  # lengths alone, until they fill the budget; at most 50000 rows, as each has a character
        lengths = docs.select("doc_id", "n").orderBy(*order).limit(most).collect()
        sums = list(accumulate(r["n"] for r in lengths))
        if len(lengths) < most or sums[-1] >= budget:
            break
        most = min(budget, most * 10)
    fit = bisect.bisect_left(sums, budget) + 1  # texts up to the one that crosses the budget; what is beyond it is never taken
    if lengths and (last := lengths[: fit][-1]["doc_id"]) is not None:
        docs = docs.where(F.col("doc_id") <= last)
    rows = docs.orderBy(*order).limit(fit).select("doc_id", F.substring("text", 1, budget + 1).alias("text")).collect()  # under 100001 characters
    items = [context.Candidate(str(i), "", "", "", r["text"], 0.0, True, "") for i, r in enumerate(rows)]
    return spark.createDataFrame([(rows[int(c.node_id)]["doc_id"], c.content) for c in context.pack(items, budget)[0]], "doc_id bigint, content string")
