"""Queries that parse Markdown files, build their graph and examine it, and what they equal in SQL.

The files are made from the table of documents: front matter, headings, links,
wiki links, code.  So the whole way from text to warnings is compared.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Config, GraphTables
from ..operators import extract, health, resolve
from ..operators.build import build_graph
from ..session import stored
from ..sources.markdown import parse_files
from .registry import query
from .starmap import table

STATES = ("active", "active", "deprecated", "active", "superseded")
KINDS = ("adr", "design", "other", "spec")

#: pp: a row for each file; n, word, lang and the columns of its record.  e_id(): an entity's id.
PAPERS_SQL = """pp AS (SELECT doc_id AS n, lang, coalesce(nullif(regexp_extract(text, '[A-Za-z]{4,}'), ''), 'Empty') AS word, 'papers/paper-' || doc_id || '.md' AS path,
  'document:' || substr(sha1('document:papers/paper-' || doc_id || '.md'), 1, 20) AS id, ['active', 'active', 'deprecated', 'active', 'superseded'][doc_id % 5 + 1] AS status, ['adr', 'design', 'other', 'spec'][doc_id % 4 + 1] AS type FROM documents),
ps AS (SELECT n, id AS document_id, path, unnest([
  struct_pack(anchor := 'paper-' || n, heading := 'Paper ' || n, level := 1, a := 10, b := 11), struct_pack(anchor := lower(word) || '-notes', heading := word || ' notes', level := 2, a := 12, b := 14),
  struct_pack(anchor := 'part', heading := 'Part', level := 2, a := 15, b := 19), struct_pack(anchor := 'part-2', heading := 'Part', level := 2, a := 20, b := 21)], recursive := true) FROM pp),
pi AS (SELECT *, 'section:' || substr(sha1('section:' || document_id || ':' || anchor), 1, 20) AS id FROM ps),
pe AS (SELECT n, id AS document_id, path, unnest([
  struct_pack(name := 'Gadget' || n // 3, kind := 'symbol', role := 'definition', provenance := 'frontmatter', confidence := 1.0::DOUBLE, a := NULL::INT),
  struct_pack(name := 'Part', kind := 'symbol', role := 'definition', provenance := 'heading', confidence := 0.8, a := 15), struct_pack(name := 'Part', kind := 'symbol', role := 'definition', provenance := 'heading', confidence := 0.8, a := 20),
  struct_pack(name := 'Call' || n % 20 || 'Error', kind := 'error_code', role := 'reference', provenance := 'regex', confidence := 0.6, a := 12), struct_pack(name := 'Call' || n % 20 || 'Error', kind := 'error_code', role := 'reference', provenance := 'inline_code', confidence := 0.75, a := 12),
  struct_pack(name := 'Widget' || n % 30, kind := 'symbol', role := 'reference', provenance := 'code_block', confidence := 0.7, a := 15), struct_pack(name := 'Base', kind := 'symbol', role := 'reference', provenance := 'code_block', confidence := 0.7, a := 15)], recursive := true) FROM pp),
pl AS (SELECT p.n, p.id AS from_id, p.path AS from_path, 'markdown' AS kind, 'paper-' || (p.n + 1) || '.md#part' AS raw, 13 AS line, t.n AS target FROM pp p LEFT JOIN pp t ON t.n = p.n + 1
  UNION ALL SELECT p.n, p.id, p.path, 'wikilink', '[[Paper ' || p.n // 3 || '|third]]', 16, t.n FROM pp p LEFT JOIN pp t ON t.n = p.n // 3)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, modified, content of the files."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    third = F.floor(n / 3)
    lines = [
        F.lit("---"), say("title: Paper ", n), say("status: ", pick(STATES, n)), say("type: ", pick(KINDS, n)), F.when(n % 9 == 0, "tags: [one, Two Words]").otherwise("tags: [one]"),
        say("defines: Gadget", third), say("depends_on: paper-", F.floor(n / 2), ".md"), say("source_refs: [./src/", F.col("lang"), ".ts]"), F.lit("---"),
        say("# Paper ", n), F.lit(""), say("## ", F.when(word == "", "Empty").otherwise(word), " notes"), say("Text with `Call", n % 20, "Error` and [next](paper-", n + 1, ".md#part) here."), F.lit(""),
        F.lit("## Part"), say("See [[Paper ", third, "|third]] here."), F.lit("```ts"), say("class Widget", n % 30, " extends Base {}"), F.lit("```"), F.lit("## Part"), F.lit("End."),
    ]
    return d.select(say("papers/paper-", n, ".md").alias("path"), F.lit("2026-01-01").cast("timestamp").alias("modified"), F.concat_ws("\n", *lines).cast("binary").alias("content"))


def parsed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(parse_files(papers(spark, sf_dir)))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GraphTables]:
    parsed = parsed_papers(spark, sf_dir)
    return parsed, build_graph(parsed, Config(), "2026-02-01T00:00:00.000Z")


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GraphTables]:
    """As ``graph``, its tables stored, as an examination reads them again and again."""
    parsed, g = graph(spark, sf_dir)
    names = ("documents", "sections", "entities", "source_refs", "edges", "chunks")
    return parsed, replace(g, **{n: stored(getattr(g, n)) for n in names})


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c.rsplit(".", 1)[-1])


@query(
    f"""WITH {PAPERS_SQL} SELECT id, path, 'Paper ' || n AS title, status, type, CASE WHEN n % 9 = 0 THEN 'one,Two Words' ELSE 'one' END AS tags, 'Gadget' || n // 3 AS defines,
'paper-' || n // 2 || '.md' AS depends_on, './src/' || lang || '.ts' AS source_refs, '2026-01-01T00:00:00.000Z' AS updated_at FROM pp"""
)
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse_files(papers(spark, sf_dir)).where("error IS NULL AND size(diagnostics) = 0")
    return p.select("id", "path", "title", "front.status", "front.type", *[_joined(f"front.{c}") for c in ("tags", "defines", "depends_on", "source_refs")], "updated_at")


@query(f"WITH {PAPERS_SQL} SELECT path, id, anchor, heading, level, a AS start_line, b AS end_line FROM pi")
def parsed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(papers(spark, sf_dir)).select("path", F.inline("sections")).drop("content")


@query(
    f"""WITH {PAPERS_SQL}, x AS (SELECT path, n, unnest([
  struct_pack(what := 'link', a := 'next', b := 'paper-' || (n + 1) || '.md#part', line := 13, place := 12), struct_pack(what := 'wiki', a := 'Paper ' || n // 3, b := 'third', line := 16, place := 15),
  struct_pack(what := 'inline', a := 'Call' || n % 20 || 'Error', b := NULL, line := 13, place := 12), struct_pack(what := 'code', a := 'class Widget' || n % 30 || ' extends Base {{}}', b := 'ts', line := 17, place := 15)], recursive := true) FROM pp)
SELECT x.path, what, x.a AS a, x.b AS b, line, pi.id AS section_id FROM x JOIN pi ON pi.n = x.n AND pi.a = place"""
)
def parsed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, wiki links and code, with their lines and sections."""
    p = parse_files(papers(spark, sf_dir))
    row = lambda what, a, b: F.transform(F.col(what[1]), lambda x: F.struct(F.lit(what[0]).alias("what"), x[a].alias("a"), (x[b] if b else F.lit(None).cast("string")).alias("b"), x["line"].alias("line"), x["section_id"].alias("section_id")))
    return p.select("path", F.inline(F.concat(row(("link", "links"), "text", "url"), row(("wiki", "wiki_links"), "target", "alias"), row(("inline", "inline_code"), "value", None), row(("code", "code_blocks"), "value", "language"))))


@query(
    f"""WITH {PAPERS_SQL} SELECT pe.path, name, lower(name) AS normal, kind, role, provenance, confidence, pi.id AS section_id FROM pe LEFT JOIN pi ON pi.n = pe.n AND pi.a = pe.a"""
)
def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_entities(parsed_papers(spark, sf_dir)).select("path", "name", "normal", "kind", "role", "provenance", "confidence", "section_id")


@query(
    f"""WITH {PAPERS_SQL} SELECT from_path, raw, pl.kind, line, CASE WHEN pl.kind = 'markdown' THEN s.id ELSE d.id END AS node_id, d.id AS target_id
FROM pl LEFT JOIN pp d ON d.n = pl.target LEFT JOIN pi s ON s.n = pl.target AND s.anchor = 'part'"""
)
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.all_links(parsed_papers(spark, sf_dir)).select("from_path", "raw", "kind", "line", "node_id", "target_id")


_ENTITY = "'entity:' || substr(sha1('entity:' || kind || ':' || lower(name)), 1, 20)"
_GRAPH_SQL = f"""{PAPERS_SQL},
ge AS (SELECT document_id AS from_id, id AS to_id, 'CONTAINS' AS kind, 'heading' AS provenance, 1.0::DOUBLE AS confidence, 5.0::DOUBLE AS weight FROM pi
  UNION ALL SELECT id, 'chunk:' || substr(sha1('chunk:' || id || ':content'), 1, 20), 'CONTAINS', 'heading', 1.0, 5.0 FROM pi
  UNION ALL SELECT coalesce(pi.id, pe.document_id), {_ENTITY}, CASE role WHEN 'definition' THEN 'DEFINES' ELSE 'REFERENCES' END, provenance, confidence, CASE role WHEN 'definition' THEN 10.0 ELSE 4.0 END FROM pe LEFT JOIN pi ON pi.n = pe.n AND pi.a = pe.a
  UNION ALL SELECT id, 'source_ref:' || substr(sha1('source_ref:src/' || lang || '.ts'), 1, 20), 'REFERENCES_SOURCE', 'frontmatter', 1.0, 6.0 FROM pp
  UNION ALL SELECT p.id, t.id, 'DEPENDS_ON', 'frontmatter', 1.0, 9.0 FROM pp p JOIN pp t ON t.n = p.n // 2
  UNION ALL SELECT f.id, CASE WHEN pl.kind = 'markdown' THEN s.id ELSE d.id END, 'LINKS_TO', CASE WHEN pl.kind = 'markdown' THEN 'markdown_link' ELSE 'wikilink' END, 0.9, 7.0
    FROM pl JOIN pi f ON f.n = pl.n AND f.a = CASE line WHEN 13 THEN 12 ELSE 15 END JOIN pp d ON d.n = pl.target LEFT JOIN pi s ON s.n = pl.target AND s.anchor = 'part')"""


@query(f"WITH {_GRAPH_SQL} SELECT 'edge:' || substr(sha1('edge:' || from_id || ':' || kind || ':' || to_id || ':' || provenance), 1, 20) AS id, * FROM ge")
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1].edges.select("id", "from_id", "to_id", "kind", "provenance", "confidence", "weight")


@query(
    f"""WITH {_GRAPH_SQL} SELECT 'entity' AS what, {_ENTITY.replace('kind', 'k').replace('name', 'x')} AS id, x AS label, lower(x) AS other FROM (SELECT DISTINCT name AS x, kind AS k FROM pe)
UNION ALL SELECT DISTINCT 'source', 'source_ref:' || substr(sha1('source_ref:src/' || lang || '.ts'), 1, 20), 'src/' || lang || '.ts', 'src/' || lang || '.ts' FROM pp
UNION ALL SELECT 'document', id, 'Paper ' || n, status FROM pp UNION ALL SELECT 'chunk', 'chunk:' || substr(sha1('chunk:' || id || ':content'), 1, 20), id, document_id FROM pi"""
)
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)[1]
    rows = lambda df, what, label, other: df.select(F.lit(what).alias("what"), "id", F.col(label).alias("label"), F.col(other).alias("other"))
    return rows(g.entities, "entity", "name", "normalized_name").union(rows(g.source_refs, "source", "path", "normalized_path")).union(rows(g.documents, "document", "title", "status")).union(rows(g.chunks, "chunk", "section_id", "document_id"))


@query(
    f"""WITH {_GRAPH_SQL}, l AS (SELECT f.path AS source, t.path AS target, t.status AS state, pl.line FROM pl JOIN pp f ON f.n = pl.n JOIN pp t ON t.n = pl.target WHERE f.status = 'active' AND f.n <> t.n),
deg AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest([from_id, to_id]) AS x FROM ge WHERE kind <> 'CONTAINS') GROUP BY x ORDER BY n DESC, id LIMIT 10),
dup AS (SELECT name, count(DISTINCT pe.path) AS k FROM pe JOIN pp USING (n) WHERE role = 'definition' AND pp.status = 'active' GROUP BY name HAVING count(DISTINCT pe.path) > 1)
SELECT 'link.dead' AS code, from_path AS path, line, NULL AS label FROM pl WHERE target IS NULL
UNION ALL SELECT 'tag.invalid_format', path, NULL, NULL FROM pp WHERE n % 9 = 0
UNION ALL SELECT 'document.deprecated_referenced', source, line, NULL FROM l WHERE state = 'deprecated' UNION ALL SELECT 'document.superseded_referenced', source, line, NULL FROM l WHERE state = 'superseded'
UNION ALL SELECT 'definition.duplicate', NULL, NULL, name FROM dup
UNION ALL SELECT 'storage.high_degree_node', NULL, NULL, coalesce((SELECT DISTINCT name FROM pe WHERE {_ENTITY} = deg.id), (SELECT DISTINCT 'src/' || lang || '.ts' FROM pp WHERE 'source_ref:' || substr(sha1('source_ref:src/' || lang || '.ts'), 1, 20) = deg.id)) FROM deg WHERE n >= 50"""
)
def doctor_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every warning of a whole examination."""
    parsed, g = indexed(spark, sf_dir)
    return health.run_doctor(parsed, g).warnings.select("code", "path", "line", "label")


@query(
    f"""WITH {PAPERS_SQL} SELECT DISTINCT 'src/' || lang || '.ts' AS label, (SELECT min(path) FROM pp q WHERE q.lang = pp.lang) AS path FROM pp WHERE lang IN ('de', 'fr')"""
)
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references without a file, where those of two languages are there."""
    parsed, g = graph(spark, sf_dir)
    files = spark.createDataFrame([("src/en.ts",), ("src/es.ts",), ("README.md",)], "path string")
    return health.missing_sources(parsed, g, files, lambda df, _: df).select("label", "path")


@query(
    f"""WITH {PAPERS_SQL}, x AS (SELECT 'Gadget' || n // 3 AS g, path, id FROM pp WHERE status = 'active'), twice AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
h AS (SELECT id AS document_id, 'possible_contradiction' AS state FROM pp WHERE status = 'active' UNION SELECT from_id, 'dead_link' FROM pl WHERE target IS NULL)
SELECT * FROM h"""
)
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of documents for the filter language; all active ones define Part."""
    parsed, g = indexed(spark, sf_dir)
    return health.health_states(health.run_doctor(parsed, g), g)
