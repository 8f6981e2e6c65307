"""Exports: the structural graph as JSON, indexes of documents, diagrams, bundles."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash
from ..model import EDGE_WEIGHTS, Config, GraphTables
from ..sources.bounded import read_json
from ..sources.store import SCHEMA_VERSION, counts
from .diff import source_hash

FORMAT, FORMAT_VERSION = "quillgraph-json", 1
NODE_KINDS = ("document", "section", "entity", "source_ref")
COUNTS = ("documents", "sections", "entities", "source_refs", "edges", "chunks", "chunk_vectors")


def structural_nodes(g: GraphTables) -> DataFrame:
    """kind, sort, id, node (JSON) of documents, sections, entities and source references."""
    paths = g.documents.select(F.col("id").alias("document_id"), "path")

    def rows(df: DataFrame, kind: str, sort: list, fields: list) -> DataFrame:
        node = F.to_json(F.struct("id", F.lit(kind).alias("kind"), *fields))
        return df.select(F.lit(NODE_KINDS.index(kind)).alias("k"), F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in sort]).alias("sort"), "id", node.alias("node"))

    c = F.col
    s = g.sections.join(paths, "document_id", "left")
    return (
        rows(g.documents, "document", [c("path"), c("id")], [c("title").alias("label"), c("path"), c("type").alias("documentType"), c("status"), c("trust_tier").alias("trustTier")])
        .union(rows(s, "section", [c("path"), F.lpad("start_line", 10, "0"), c("id")], [c("heading").alias("label"), c("document_id").alias("documentId"), c("anchor"), c("level"), F.struct(c("start_line").alias("start"), c("end_line").alias("end")).alias("lines")]))
        .union(rows(g.entities, "entity", [c("kind"), c("normalized_name"), c("id")], [c("name").alias("label"), c("kind").alias("entityKind"), c("normalized_name").alias("normalizedName"), c("namespace")]))
        .union(rows(g.source_refs, "source_ref", [c("path"), c("id")], [c("path").alias("label"), c("path"), c("normalized_path").alias("normalizedPath")]))
    )


def structural_edges(g: GraphTables) -> DataFrame:
    """Edges whose both ends are structural nodes; those of chunks are left out."""
    ids = g.documents.select("id").union(g.sections.select("id")).union(g.entities.select("id")).union(g.source_refs.select("id"))
    return g.edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def graph_json(g: GraphTables, config: Config | None = None) -> dict:
    """The whole structural graph as one value, for graphs that fit one file; ``write_graph_json`` for others."""
    nodes = [json.loads(r["node"]) for r in structural_nodes(g).orderBy("k", "sort").collect()]  # the export is one document
    order = ("from_id", "to_id", "kind", "provenance", "id")
    edges = [
        {"id": r["id"], "fromId": r["from_id"], "toId": r["to_id"], "kind": r["kind"], "weight": r["weight"], "confidence": r["confidence"], "provenance": r["provenance"]}
        for r in structural_edges(g).orderBy(*order).collect()
    ]
    n = counts(g)
    own = lambda kind: sum(x["kind"] == kind for x in nodes)
    value = {
        "format": FORMAT, "formatVersion": FORMAT_VERSION, "schemaVersion": SCHEMA_VERSION, "exportProfile": "structural", "sourceHash": source_hash(g.documents, config), "counts": n,
        "exportedCounts": {"documents": own("document"), "sections": own("section"), "entities": own("entity"), "source_refs": own("source_ref"), "nodes": len(nodes), "edges": len(edges)},
        "nodes": nodes, "edges": edges,
    }
    return value | {"graphHash": canonical_hash(value)}


def write_graph_json(g: GraphTables, path: str) -> None:
    """nodes/ and edges/ as JSON lines, written by the executors in sorted order."""
    structural_nodes(g).orderBy("k", "sort").select(F.col("node").alias("value")).write.text(f"{path}/nodes")
    structural_edges(g).orderBy("from_id", "to_id", "kind", "provenance", "id").select("id", "from_id", "to_id", "kind", "weight", "confidence", "provenance").write.json(f"{path}/edges")


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    at: str | None = None


def verify_graph_json(value: Any) -> tuple[list[Problem], list[str]]:
    """(errors, notes)."""
    if not isinstance(value, dict):
        return [Problem("graphjson.not_object", "the export must be an object")], []
    errors: list[Problem] = []

    def wrong(code: str, message: str, at: str | None = None) -> None:
        errors.append(Problem(f"graphjson.{code}", message, at))

    if value.get("format") != FORMAT:
        wrong("format", f"the format must be {FORMAT}", str(value.get("format")))
    if value.get("formatVersion") != FORMAT_VERSION:
        wrong("format_version", "the format's version isn't known", str(value.get("formatVersion")))
    if not isinstance(value.get("schemaVersion"), int):
        wrong("schema_version", "the schema's version must be a number")
    numbers = lambda v, names: isinstance(v, dict) and all(isinstance(v.get(k), int) for k in names)
    if not numbers(value.get("counts"), COUNTS):
        wrong("counts", "counts of all tables are needed")
    exported = value.get("exportedCounts")
    if not numbers(exported, ("documents", "sections", "entities", "source_refs", "nodes", "edges")):
        wrong("exported_counts", "counts of what was exported are needed")
        exported = None
    for name in ("nodes", "edges"):
        if not isinstance(value.get(name), list):
            wrong(name, f"{name} must be a list")
    nodes, edges = (value[n] if isinstance(value.get(n), list) else [] for n in ("nodes", "edges"))
    ids: set[str] = set()
    for i, node in enumerate(nodes):
        if not isinstance(node, dict) or not isinstance(node.get("id"), str) or not isinstance(node.get("kind"), str):
            wrong("node_shape", "a node needs an id and a kind", f"nodes[{i}]")
            continue
        if node["kind"] not in NODE_KINDS:
            wrong("node_kind", f"{node['kind']!r} is no kind of node", node["id"])
        if node["id"] in ids:
            wrong("node_duplicate", "two nodes have this id", node["id"])
        ids.add(node["id"])
    for i, edge in enumerate(edges):
        if not isinstance(edge, dict) or not all(isinstance(edge.get(k), str) for k in ("id", "fromId", "toId", "kind")):
            wrong("edge_shape", "an edge needs an id, two ends and a kind", f"edges[{i}]")
            continue
        if edge["kind"] not in EDGE_WEIGHTS:
            wrong("edge_kind", f"{edge['kind']!r} is no kind of edge", edge["id"])
        for end in ("fromId", "toId"):
            if edge[end] not in ids:
                wrong("edge_endpoint", f"{end} {edge[end]} is missing", edge["id"])
    if exported is not None:
        have = {"nodes": len(nodes), "edges": len(edges)} | {n: sum(isinstance(x, dict) and x.get("kind") == k for x in nodes) for n, k in zip(("documents", "sections", "entities", "source_refs"), NODE_KINDS)}
        for k, n in have.items():
            if exported[k] != n:
                wrong("count_mismatch", f"{exported[k]} {k} are counted, {n} are there", k)
    notes = ["Edges of chunks are not exported."] if exported is not None and numbers(value.get("counts"), COUNTS) and exported["edges"] < value["counts"]["edges"] else []
    given = value.get("graphHash")
    if not isinstance(given, str):
        wrong("graph_hash", "the hash is missing")
    elif canonical_hash({k: v for k, v in value.items() if k != "graphHash"}) != given:
        wrong("graph_hash", "the hash doesn't fit the content", given)
    return errors, notes


def docs_index(g: GraphTables) -> DataFrame:
    """A row for each document: what it defines, its sources, documents it links to and that link to it."""
    own = g.documents.select("id", F.col("id").alias("doc")).union(g.sections.select("id", "document_id"))
    e = structural_edges(g)
    start = e.join(own.select(F.col("id").alias("from_id"), F.col("doc").alias("from_doc")), "from_id", "left")
    ends = start.join(own.select(F.col("id").alias("to_id"), F.col("doc").alias("to_doc")), "to_id", "left")
    paths = g.documents.select(F.col("id").alias("d"), "path")
    names = lambda df, key, c, alias: df.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(c)).alias(alias))
    defines = names(ends.where("kind = 'DEFINES'").join(g.entities.select(F.col("id").alias("to_id"), "name"), "to_id"), "from_doc", "name", "defines")
    sources = names(ends.where("kind IN ('IMPLEMENTS', 'REFERENCES_SOURCE')").join(g.source_refs.select(F.col("id").alias("to_id"), "path"), "to_id"), "from_doc", "path", "source_refs")
    across = ends.where("from_doc IS NOT NULL AND to_doc IS NOT NULL AND from_doc <> to_doc")
    outward = names(across.join(paths, F.col("to_doc") == F.col("d")), "from_doc", "path", "outbound")
    inward = names(across.join(paths, F.col("from_doc") == F.col("d")), "to_doc", "path", "inbound")
    out = g.documents.select("id", "path", "title", "status", F.col("type").alias("document_type"), "trust_tier")
    for df in (defines, sources, outward, inward):
        out = out.join(df, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("path", "title", "status", "document_type", "trust_tier", *[F.coalesce(c, none).alias(c) for c in ("defines", "source_refs", "outbound", "inbound")]).orderBy("path")


def markdown_index(g: GraphTables, graph_hash: str) -> DataFrame:
    """path, markdown: the section of each document in an index of wiki links."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")).otherwise("none")
    lines = [("Status", F.col("status")), ("Type", F.col("document_type")), ("Trust tier", F.col("trust_tier")), ("Defines", listed("defines")), ("Source refs", listed("source_refs")), ("Outbound links", listed("outbound")), ("Inbound links", listed("inbound"))]
    body = F.concat(F.lit("### [["), "path", F.lit("]]\n"), *[F.concat(F.lit(f"\n- {k}: "), v) for k, v in lines])
    return docs_index(g).select("path", body.alias("markdown"), F.lit(graph_hash).alias("graph_hash"))


def render_markdown_index(g: GraphTables, graph_hash: str) -> str:
    parts = [r["markdown"] for r in markdown_index(g, graph_hash).collect()]  # one document
    return "\n\n".join(["# Document index", f"Graph hash: `{graph_hash}`\n\n## Documents", *parts]) + "\n"


def mermaid(trace: dict) -> str:
    """A flow chart of a traced path."""
    if not trace["found"] or not trace["steps"]:
        message = (trace.get("message") or "There is no path.").replace("\n", " ").replace("--", "- -")
        return f"%% {message}\nflowchart LR"
    name = lambda i: "n_" + re.sub(r"[^A-Za-z0-9_]", "_", i)
    quote = lambda s: re.sub(r"\r?\n", " ", s.replace("\\", "\\\\").replace('"', '\\"'))
    labels = {s[f"{end}_id"]: s[f"{end}_label"] for s in trace["steps"] for end in ("from", "to")}
    lines = ["flowchart LR", *[f'  {name(i)}["{quote(labels[i])}"]' for i in sorted(labels)]]
    for s in trace["steps"]:
        text = f"{s['kind']} / {s['provenance']} / {s['confidence']:.2f}"
        lines.append(f'  {name(s["from_id"])} -- "{quote(text)}" --> {name(s["to_id"])}')
    return "\n".join(lines)


def source_bridge(g: GraphTables, artifact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_ref, artifact_path, symbols; source_ref without a file): ``artifact`` has path and symbols (name, kind); the last row of a path counts."""
    numbered = artifact.where("path IS NOT NULL").withColumn("__at", F.monotonically_increasing_id())
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    last = numbered.select(F.lower(clean).alias("normalized_path"), clean.alias("artifact_path"), "symbols", "__at").groupBy("normalized_path").agg(F.max_by(F.struct("artifact_path", "symbols"), "__at").alias("f"))
    named = F.filter(F.coalesce("f.symbols", F.array().cast("array<struct<name: string, kind: string>>")), lambda s: s["name"].isNotNull())
    joined = g.source_refs.select(F.col("path").alias("source_ref"), "normalized_path").join(last, "normalized_path", "left")
    hit = joined.where("f IS NOT NULL").select("source_ref", "f.artifact_path", F.sort_array(named).alias("symbols")).orderBy("source_ref")
    return hit, joined.where("f IS NULL").select("source_ref").orderBy("source_ref")


# -------------------------------------------------------------------- bundles
def create_bundle(g: GraphTables, folder: str, config: Config | None = None) -> dict:
    """Tables as Parquet under ``folder`` and a manifest with their counts and hashes."""
    tables = {}
    for name, df in g.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        tables[name] = table_hash(df.sparkSession.read.parquet(f"{folder}/{name}"))
    manifest = {"format": "quillgraph-bundle", "formatVersion": 1, "schemaVersion": SCHEMA_VERSION, "sourceHash": source_hash(g.documents, config), "counts": counts(g), "tables": tables}
    manifest["bundleHash"] = canonical_hash(manifest)
    g.documents.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def table_hash(df: DataFrame) -> str:
    """A hash that doesn't depend on the order of rows: the sums of two hashes of each row."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = df.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(7), row).cast("decimal(38,0)").alias("b")).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return canonical_hash([str(x) for x in sums])


def verify_bundle(spark, folder: str, g: GraphTables | None = None, config: Config | None = None) -> tuple[list[Problem], bool | None]:
    """(errors, whether the bundle is as fresh as ``g``)."""
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    except Exception as e:  # noqa: BLE001
        return [Problem("bundle.manifest", f"the manifest can't be read: {type(e).__name__}")], None
    errors = []
    if canonical_hash({k: v for k, v in manifest.items() if k != "bundleHash"}) != manifest.get("bundleHash"):
        errors.append(Problem("bundle.hash", "the manifest was changed"))
    for name, want in manifest.get("tables", {}).items():
        try:
            if table_hash(spark.read.parquet(f"{folder}/{name}")) != want:
                errors.append(Problem("bundle.table", "the rows differ from the manifest", name))
        except Exception:  # noqa: BLE001
            errors.append(Problem("bundle.table", "the table can't be read", name))
    return errors, None if g is None else source_hash(g.documents, config) == manifest.get("sourceHash")


def read_graph_json(path: str) -> Any:
    return read_json(os.fspath(path))
