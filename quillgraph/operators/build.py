"""From parsed documents to the graph's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import estimate_tokens, trim
from ..functions.vectors import embed_column
from ..model import EDGE_WEIGHTS, SCHEMAS, Config, GraphTables
from .extract import extract_entities, kind_of, normal
from .resolve import all_links, first_by, first_by_rare, front_references, posix

RELATIONS = {"depends_on": "DEPENDS_ON", "supersedes": "SUPERSEDES", "deprecated_by": "DEPRECATED_BY"}


def now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def _edges(df: DataFrame, a: str, b: str, kind: Column, provenance: Column, confidence: Column, created: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    rows = df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), kind.alias("kind"), provenance.alias("provenance"), confidence.cast("double").alias("confidence"))
    return rows.select(
        stable_id("edge", F.concat_ws(":", "from_id", "kind", "to_id", "provenance")).alias("id"), "from_id", "to_id", "kind", weights[F.col("kind")].alias("weight"),
        "confidence", "provenance", F.lit(None).cast("string").alias("metadata_json"), F.lit(created).alias("created_at"),
    )


def _cast(df: DataFrame, table: str) -> DataFrame:
    names = [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]
    return df.select(*names)


def build_graph(parsed: DataFrame, config: Config | None = None, indexed_at: str | None = None) -> GraphTables:
    """The seven tables; ``parsed`` should be stored, as it is read several times.

    Equal ids keep the row of the last path; entities the spelling met first,
    by path and place.
    """
    config, created = config or Config(), indexed_at or now()
    spark = parsed.sparkSession
    parsed = first_by_rare(parsed.where("error IS NULL"), ["id"], [F.col("path").desc()])
    front = F.col("front")
    metadata = F.to_json(F.struct(front["trust_tier"].alias("declaredTrustTier"), front["id"].alias("frontmatterId"), F.coalesce(front["tags"], F.array().cast("array<string>")).alias("tags")))
    documents = parsed.select(
        "id", "path", "title", F.coalesce(front["type"], F.lit("other")).alias("type"), F.coalesce(front["status"], F.lit("active")).alias("status"), "hash",
        F.coalesce(front["trust_tier"], F.lit("authored")).alias("trust_tier"), "updated_at", F.lit(created).alias("indexed_at"), F.coalesce(front["tags"], F.array().cast("array<string>")).alias("tags"), metadata.alias("metadata_json"),
    )
    placed = parsed.select(F.col("id").alias("document_id"), F.posexplode("sections").alias("i", "s"))
    sections = first_by_rare(placed.select("s.id", "document_id", "s.anchor", "s.heading", "s.level", "s.start_line", "s.end_line", "s.content", "i"), ["id"], [F.col("i").desc()])
    chunk = stable_id("chunk", F.concat("id", F.lit(":content")))
    chunks = sections.select(
        chunk.alias("id"), "document_id", F.col("id").alias("section_id"), "content", estimate_tokens(F.col("content")).alias("token_estimate"),
        F.to_json(F.struct("heading", "anchor")).alias("metadata_json"),
    )

    extracted = extract_entities(parsed, config)
    relations = front_references(parsed, list(RELATIONS)).withColumn("kind", F.create_map(*[F.lit(x) for p in RELATIONS.items() for x in p])[F.col("field")])
    loose = relations.where("node_id IS NULL").select(
        F.col("from_path").alias("path"), F.col("raw").alias("name"), kind_of(F.col("raw")).alias("entity_kind"), normal(F.col("raw")).alias("normal"),
        F.struct(F.lit(9).alias("o0"), F.col("i").alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3")).alias("seq"), "from_id", "kind",
    )
    entity_id = lambda kind: stable_id("entity", F.concat_ws(":", kind, F.col("normal")))
    named = extracted.select("name", "normal", F.col("kind").alias("k"), "path", "seq").union(loose.select("name", "normal", "entity_kind", "path", "seq"))
    entities = named.groupBy("k", "normal").agg(F.min_by("name", F.struct("path", "seq")).alias("name")).select(
        entity_id(F.col("k")).alias("id"), "name", F.col("normal").alias("normalized_name"), F.col("k").alias("kind"), F.lit(None).cast("string").alias("namespace"),
        F.lit(created).alias("created_at"), F.lit(None).cast("string").alias("metadata_json"),
    )

    fields = {"implements": ("IMPLEMENTS", 0), "source_refs": ("REFERENCES_SOURCE", 1)}

    def paths(name: str, kind: str, o: int) -> Column:
        return F.transform(front[name], lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(o).alias("o"), i.alias("i"), posix(trim(v)).alias("ref")))

    listed = F.concat(*[paths(n, k, o) for n, (k, o) in fields.items()])
    refs = parsed.select(F.col("id").alias("from_id"), "path", F.inline(listed)).withColumn("ref_id", stable_id("source_ref", F.lower("ref")))
    source_refs = refs.groupBy("ref_id").agg(F.min_by("ref", F.struct("path", "o", "i")).alias("path")).select(
        F.col("ref_id").alias("id"), "path", F.lower("path").alias("normalized_path"), F.lit(created).alias("created_at"), F.lit(None).cast("string").alias("metadata_json")
    )

    lit = F.lit
    heading = lambda df, a, b: _edges(df, a, b, lit("CONTAINS"), lit("heading"), lit(1.0), created)
    mentions = extracted.withColumn("from_id", F.coalesce("section_id", "document_id")).withColumn("to_id", entity_id(F.col("kind")))
    links = all_links(parsed).where("node_id IS NOT NULL").withColumn("from_node", F.coalesce("section_id", "from_id"))
    edges = (
        heading(sections, "document_id", "id")
        .union(heading(chunks.select("section_id", "id"), "section_id", "id"))
        .union(_edges(mentions, "from_id", "to_id", F.when(F.col("role") == "definition", "DEFINES").otherwise("REFERENCES"), F.col("provenance"), F.col("confidence"), created))
        .union(_edges(refs, "from_id", "ref_id", F.col("kind"), lit("frontmatter"), lit(1.0), created))
        .union(_edges(relations.where("node_id IS NOT NULL"), "from_id", "node_id", F.col("kind"), lit("frontmatter"), lit(1.0), created))
        .union(_edges(loose.withColumn("to_id", entity_id(F.col("entity_kind"))), "from_id", "to_id", F.col("kind"), lit("frontmatter"), lit(0.85), created))
        .union(_edges(links, "from_node", "node_id", lit("LINKS_TO"), F.when(F.col("kind") == "markdown", "markdown_link").otherwise("wikilink"), lit(0.9), created))
    )
    edges = first_by(edges, ["from_id", "to_id", "kind", "provenance"], [F.col("confidence").desc()])
    return GraphTables(
        *[_cast(df, name) for name, df in (("documents", documents), ("sections", sections), ("entities", entities), ("source_refs", source_refs), ("edges", edges), ("chunks", chunks))],
        vectors(chunks, config, created) if config.semantic else spark.createDataFrame([], SCHEMAS["chunk_vectors"]),
    )


def vectors(chunks: DataFrame, config: Config, created: str) -> DataFrame:
    made = embed_column(F.col("content"), config.provider, config.embedding_model, config.dimensions, config.batch_size)
    return chunks.select(
        F.col("id").alias("chunk_id"), F.lit(config.provider).alias("provider"), F.lit(config.embedding_model).alias("model"),
        F.lit(config.dimensions).alias("dimensions"), made.alias("vector"), F.lit(created).alias("created_at"),
    )


def with_edges(graph: GraphTables, edges: DataFrame) -> GraphTables:
    return GraphTables(graph.documents, graph.sections, graph.entities, graph.source_refs, edges, graph.chunks, graph.chunk_vectors, {k: v for k, v in graph.extra.items() if k != "adjacency"})
