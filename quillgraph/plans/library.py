"""The test tables seen as an indexed library: the seven tables of a graph, and the same in SQL.

Texts play Markdown files: each line is a section and a chunk, and the word
that a text begins with is an entity, which every third text defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphTables
from .starmap import table

TYPES = ("adr", "design", "spec", "runbook", "incident", "meeting")
STATUSES = ("active", "draft", "deprecated", "active", "superseded", "archived", "active")
TIERS = ("authored", "generated", "validated", "external", "untrusted")
INDEXED_AT = "2026-02-01T00:00:00.000Z"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The tables as common table expressions: l_documents, l_lines, l_sections, l_chunks, l_entities, l_source_refs, l_edges.
LIBRARY_SQL = f"""l_raw AS (SELECT doc_id AS n, text, lang, source, regexp_extract(text, '^[A-Z][a-z]{{4,}}') AS word, string_split(text, chr(10)) AS parts FROM documents),
l_documents AS (SELECT 'doc:' || n AS id, source || '/' || n || '.md' AS path, 'Text ' || n AS title, {_list(TYPES)}[n % {len(TYPES)} + 1] AS type,
  {_list(STATUSES)}[n % {len(STATUSES)} + 1] AS status, md5(text) AS hash, {_list(TIERS)}[n % {len(TIERS)} + 1] AS trust_tier,
  '2026-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS updated_at, '{INDEXED_AT}' AS indexed_at, [lang] AS tags, n FROM l_raw),
l_lines AS (SELECT n, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i FROM l_raw),
l_sections AS (SELECT 'sec:' || n || ':' || i AS id, 'doc:' || n AS document_id, 'line-' || i AS anchor, 'Line ' || i AS heading, 1 AS level, i + 1 AS start_line, i + 1 AS end_line, line AS content, n, i FROM l_lines),
l_chunks AS (SELECT 'chunk:' || n || ':' || i AS id, 'doc:' || n AS document_id, CASE WHEN i % 4 <> 3 THEN 'sec:' || n || ':' || i END AS section_id, line AS content, n, i FROM l_lines),
l_entities AS (SELECT DISTINCT 'ent:' || lower(word) AS id, word AS name, lower(word) AS normalized_name, CASE WHEN length(word) % 2 = 0 THEN 'symbol' ELSE 'concept' END AS kind FROM l_raw WHERE word <> ''),
l_source_refs AS (SELECT DISTINCT 'src:' || lang AS id, 'src/' || upper(lang) || '.ts' AS path, 'src/' || lang || '.ts' AS normalized_path FROM l_raw),
l_ends AS (SELECT 'doc:' || n AS from_id, 'sec:' || n || ':' || i AS to_id, 'CONTAINS' AS kind, 5.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence, 'structure' AS provenance FROM l_lines
  UNION ALL SELECT 'sec:' || n || ':0', 'ent:' || lower(word), 'DEFINES', 10.0 - n % 2, 0.8, 'heading' FROM l_raw WHERE word <> '' AND n % 3 = 0
  UNION ALL SELECT 'doc:' || n, 'ent:' || lower(word), 'REFERENCES', 4.0, 0.6, 'regex' FROM l_raw WHERE word <> '' AND n % 3 <> 0
  UNION ALL SELECT 'doc:' || n, 'doc:' || n // 2, 'LINKS_TO', 7.0, 0.9, 'markdown_link' FROM l_raw WHERE n % 4 = 1
  UNION ALL SELECT 'doc:' || n, 'src:' || lang, 'REFERENCES_SOURCE', 6.0, 1.0, 'frontmatter' FROM l_raw WHERE n % 5 = 2
  UNION ALL SELECT 'doc:' || n, 'doc:' || (n + 10), 'RELATED_TO', 2.0, 0.9, 'embedding_similarity' FROM l_raw WHERE n % 10 = 7),
l_edges AS (SELECT kind || '|' || from_id || '|' || to_id AS id, * FROM l_ends),
l_owners AS (SELECT id, id AS document_id FROM l_documents UNION ALL SELECT id, document_id FROM l_sections UNION ALL SELECT id, document_id FROM l_chunks)"""


def library(spark: SparkSession, sf_dir: str) -> GraphTables:
    n, word, none = F.col("n"), F.col("word"), F.lit(None).cast("string")
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text", "lang", "source", F.regexp_extract("text", "^[A-Z][a-z]{4,}", 0).alias("word"))
    doc, ent = _text("doc:", n), _text("ent:", F.lower(word))
    documents = raw.select(
        doc.alias("id"), _text(F.col("source"), "/", n, ".md").alias("path"), _text("Text ", n).alias("title"), _pick(TYPES, n).alias("type"), _pick(STATUSES, n).alias("status"), F.md5("text").alias("hash"),
        _pick(TIERS, n).alias("trust_tier"), _text("2026-01-", F.lpad((n % 28 + 1).cast("string"), 2, "0"), "T00:00:00.000Z").alias("updated_at"), F.lit(INDEXED_AT).alias("indexed_at"), F.array("lang").alias("tags"), none.alias("metadata_json"),
    )
    lines = raw.select("n", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i, section = F.col("i"), _text("sec:", n, ":", F.col("i"))
    sections = lines.select(section.alias("id"), doc.alias("document_id"), _text("line-", i).alias("anchor"), _text("Line ", i).alias("heading"), F.lit(1).alias("level"), (i + 1).alias("start_line"), (i + 1).alias("end_line"), F.col("line").alias("content"))
    chunks = lines.select(_text("chunk:", n, ":", i).alias("id"), doc.alias("document_id"), F.when(i % 4 != 3, section).alias("section_id"), F.col("line").alias("content"), F.length("line").alias("token_estimate"), none.alias("metadata_json"))
    named = raw.where("word <> ''")
    entities = named.select(ent.alias("id"), word.alias("name"), F.lower(word).alias("normalized_name"), F.when(F.length(word) % 2 == 0, "symbol").otherwise("concept").alias("kind"), none.alias("namespace"), none.alias("created_at"), none.alias("metadata_json")).distinct()
    sources = raw.select(_text("src:", F.col("lang")).alias("id"), _text("src/", F.upper("lang"), ".ts").alias("path"), _text("src/", F.col("lang"), ".ts").alias("normalized_path"), none.alias("created_at"), none.alias("metadata_json")).distinct()

    def ends(df: DataFrame, a: Column, b: Column, kind: str, weight: Column, confidence: float, provenance: str) -> DataFrame:
        return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"), F.lit(confidence).alias("confidence"), F.lit(provenance).alias("provenance"))

    links = (
        ends(lines, doc, section, "CONTAINS", F.lit(5.0), 1.0, "structure")
        .union(ends(named.where("n % 3 = 0"), _text("sec:", n, ":0"), ent, "DEFINES", 10 - n % 2, 0.8, "heading"))
        .union(ends(named.where("n % 3 <> 0"), doc, ent, "REFERENCES", F.lit(4.0), 0.6, "regex"))
        .union(ends(raw.where("n % 4 = 1"), doc, _text("doc:", F.floor(n / 2)), "LINKS_TO", F.lit(7.0), 0.9, "markdown_link"))
        .union(ends(raw.where("n % 5 = 2"), doc, _text("src:", F.col("lang")), "REFERENCES_SOURCE", F.lit(6.0), 1.0, "frontmatter"))
        .union(ends(raw.where("n % 10 = 7"), doc, _text("doc:", n + 10), "RELATED_TO", F.lit(2.0), 0.9, "embedding_similarity"))
    )
    edges = links.select(F.concat_ws("|", "kind", "from_id", "to_id").alias("id"), *links.columns[:5], "provenance", none.alias("metadata_json"), none.alias("created_at"))
    vectors = spark.createDataFrame([], "chunk_id string, provider string, model string, dimensions int, vector array<float>, created_at string")
    return GraphTables(documents, sections, entities, sources, edges, chunks, vectors)
