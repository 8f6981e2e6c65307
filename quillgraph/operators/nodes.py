"""Nodes of all kinds: lookup, labels, owners, the text that stands for one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import slugify_py
from ..model import GraphTables
from .resolve import first_by

PROBES = ("document", "section", "entity", "source_ref", "chunk")


def all_nodes(g: GraphTables) -> DataFrame:
    """id, kind, order, label, path, line, document_id of every node."""
    none = F.lit(None)
    d = g.documents.select("id", F.lit("document").alias("kind"), F.lit(0).alias("order"), F.col("title").alias("label"), "path", none.cast("int").alias("line"), F.col("id").alias("document_id"))
    s = g.sections.select("id", F.lit("section"), F.lit(1), "heading", none.cast("string"), "start_line", "document_id")
    e = g.entities.select("id", F.lit("entity"), F.lit(2), "name", none.cast("string"), none.cast("int"), none.cast("string"))
    r = g.source_refs.select("id", F.lit("source_ref"), F.lit(3), "path", "path", none.cast("int"), none.cast("string"))
    c = g.chunks.select("id", F.lit("chunk"), F.lit(4), "id", none.cast("string"), none.cast("int"), "document_id")
    return d.union(s).union(e).union(r).union(c)


def owners(g: GraphTables) -> DataFrame:
    """id, document_id of documents, sections and chunks."""
    return g.documents.select("id", F.col("id").alias("document_id")).union(g.sections.select("id", "document_id")).union(g.chunks.select("id", "document_id"))


def edge_owner(g: GraphTables) -> DataFrame:
    """document_id, kind, to_id: outgoing edges of a document, its sections and its chunks."""
    return g.edges.join(owners(g).withColumnRenamed("id", "from_id"), "from_id").select("document_id", "kind", "to_id")


def node_text(g: GraphTables) -> DataFrame:
    """id, text: what the target of an edge may be called."""

    def texts(df: DataFrame, *names: str) -> DataFrame:
        return df.select("id", F.explode(F.array_compact(F.array(*[F.col(n).cast("string") for n in names]))).alias("text"))

    ends = g.edges.select(F.col("to_id").alias("id"), F.col("to_id").alias("text"))
    return (
        texts(g.documents, "id", "path", "title").union(texts(g.sections, "id", "heading", "anchor"))
        .union(texts(g.entities, "id", "name", "normalized_name")).union(texts(g.source_refs, "id", "path")).union(ends).distinct()
    )


def context_chunks(g: GraphTables, ids: list[str]) -> DataFrame:
    """node_id and the first chunk of each node, with its section and document."""
    wanted = g.documents.sparkSession.createDataFrame([(i,) for i in ids], "node_id string")
    c = g.chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("c_document"), F.col("section_id").alias("c_section"), F.col("content").alias("chunk_content"))
    s = g.sections.select(F.col("id").alias("c_section"), "anchor", "heading", "start_line", "end_line")
    places = c.select(F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(n).alias("n")) for i, n in enumerate(("chunk_id", "c_section", "c_document"))])).alias("p"), "*")
    own = places.select(F.col("p.n").alias("node_id"), F.col("p.o").alias("o"), *c.columns).join(F.broadcast(wanted), "node_id")  # the nodes asked for
    rows = own.join(s, "c_section", "left")
    best = first_by(rows, ["node_id"], [F.col("o"), F.col("start_line").asc_nulls_first(), F.col("chunk_id")])
    d = g.documents.select(F.col("id").alias("c_document"), "path", "title", "status", "trust_tier", F.get_json_object("metadata_json", "$.declaredTrustTier").isNotNull().alias("declared"))
    return best.join(d, "c_document").withColumnRenamed("c_document", "document_id").withColumnRenamed("c_section", "section_id")


def both_ends(edges: DataFrame) -> DataFrame:
    """node and the edge, a row for each end."""
    return edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node"), "*")


def edges_of(g: GraphTables, ids: list[str], per_node: int | None = None, skip: str | None = None) -> DataFrame:
    """node, other and the edge, for both ends; the ``per_node`` best by weight times confidence.

    A stored index has its edges by node, so that only parts with one of
    ``ids`` (which the callers bound) are read.
    """
    sides = g.extra["adjacency"] if "adjacency" in g.extra else both_ends(g.edges)
    sides = sides if skip is None else sides.where(F.col("kind") != skip)
    near = sides.where(F.col("node").isin(ids)).withColumn("other", F.when(F.col("node") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")))
    if per_node is None:
        return near
    from .ranking import top_per_group

    return top_per_group(near, ["node"], [F.desc(F.col("weight") * F.col("confidence")), F.desc("weight"), F.desc("confidence"), F.col("id")], per_node)


@dataclass(frozen=True)
class Resolution:
    """status: found, not_found or ambiguous."""

    status: str
    query: str
    node: Row | None = None
    candidates: tuple[Row, ...] = ()


def resolve_node(g: GraphTables, query: str) -> Resolution:
    """By id, path#anchor, document path or title, source path, section heading or anchor, entity; the first that fits."""
    q = query.strip()
    if not q:
        return Resolution("not_found", query)
    low, slug = q.lower(), slugify_py(q)
    nodes = all_nodes(g)
    head, _, anchor = q.partition("#")
    head = head.strip().replace("\\", "/").removeprefix("./").lower()
    paths = [head] if head.endswith((".md", ".mdx")) else [head, f"{head}.md", f"{head}.mdx"]
    docs = g.documents.select(F.col("id").alias("document_id"), F.col("path").alias("doc_path"))
    sections = g.sections.join(docs, "document_id").select("id", F.lit("section").alias("kind"), F.col("heading").alias("label"), F.col("doc_path").alias("path"), F.col("start_line").alias("line"), "document_id", "anchor")
    blank = F.lit(None).cast("string").alias("anchor")
    plain = ["id", "kind", "label", "path", "line", "document_id"]
    tiers = [nodes.where(F.col("id") == q).select(F.col("order").alias("tier"), *plain, blank)]
    if "#" in q and head and anchor.strip():
        tiers.append(sections.where(F.lower("path").isin(paths) & (F.lower("anchor") == slugify_py(anchor))).select(F.lit(10).alias("tier"), *plain, "anchor"))
    by = nodes.where(((F.col("kind") == "document") & ((F.lower("path") == low) | (F.lower("label") == low))) | ((F.col("kind") == "source_ref") & (F.lower("path") == low)))
    tiers.append(by.select(F.when(F.col("kind") == "document", 20).otherwise(30).alias("tier"), *plain, blank))
    tiers.append(sections.where((F.lower("label") == low) | (F.lower("anchor") == slug)).select(F.lit(40).alias("tier"), *plain, "anchor"))
    named = g.entities.where(F.col("normalized_name") == low)
    tiers.append(named.select(F.lit(50).alias("tier"), "id", F.lit("entity").alias("kind"), F.col("name").alias("label"), F.col("kind").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("document_id"), blank))
    found = tiers[0]
    for t in tiers[1:]:
        found = found.union(t)
    rows = found.orderBy("tier", "path", "line", "id").limit(50).collect()  # at most 50 candidates
    if not rows:
        return Resolution("not_found", query)
    first = [r for r in rows if r["tier"] == rows[0]["tier"]]
    if rows[0]["tier"] == 40 and len(first) > 1:
        return Resolution("ambiguous", query, None, tuple(first))
    return Resolution("found", query, rows[0])
