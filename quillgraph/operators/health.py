"""Documentation health: stale indexes, dead links, orphans, collisions, risks.

Every check is a DataFrame of warnings with one schema; the report is their
union, so it runs as one job however many checks there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..model import Config, GraphTables
from ..session import materialize
from . import graph
from .extract import content_risks
from .nodes import all_nodes, owners
from .resolve import all_links, front_references, is_local_document, posix

SEVERITY = {
    **dict.fromkeys(("index.stale", "document.parse_failed", "link.dead", "source_ref.missing"), "error"),
    **dict.fromkeys((
        "front_matter.invalid_yaml", "front_matter.not_mapping", "front_matter.unclosed", "front_matter.invalid_field", "document.deprecated_referenced",
        "document.superseded_referenced", "definition.missing", "definition.duplicate", "content.risk", "storage.generated_path_indexed", "storage.oversized", "storage.vector_anomaly",
    ), "warn"),
    **dict.fromkeys(("document.orphan", "document.weakly_linked", "document.deleted", "tag.invalid_format", "link.non_posix_path", "graph.missing_decision_link", "storage.text_shadow_large", "storage.high_degree_node"), "info"),
}
REMEDY = {
    "index.stale": "Index the project again before trusting the other checks.",
    "document.parse_failed": "Repair the file or exclude it.",
    "link.dead": "Correct the target or create the document.",
    "source_ref.missing": "Correct the path or drop the reference.",
    "front_matter.invalid_yaml": "Repair the YAML block.",
    "front_matter.not_mapping": "Write the block as keys and values.",
    "front_matter.unclosed": "Close the block with three hyphens.",
    "front_matter.invalid_field": "Give the field a value of the kind it takes.",
    "document.deprecated_referenced": "Link to what replaces the deprecated document.",
    "document.superseded_referenced": "Link to the document that supersedes this one.",
    "definition.missing": "State what the document defines.",
    "definition.duplicate": "Keep one definition, or name the others apart.",
    "content.risk": "Look at the line before an agent reads it.",
    "storage.generated_path_indexed": "Exclude the folder unless its files are written by hand.",
    "storage.oversized": "Look at what is indexed and exclude generated folders.",
    "storage.text_shadow_large": "Look for unusually large files.",
    "storage.vector_anomaly": "Index again with vectors.",
    "storage.high_degree_node": "Narrow, rename or ignore a name that is everywhere.",
    "document.orphan": "Link the document from another, or state its relations.",
    "document.weakly_linked": "Link the document to more of the graph.",
    "document.deleted": "If the deletion was meant, look for links that remain.",
    "tag.invalid_format": "Write tags in lower case with digits, dots, slashes, hyphens or underscores.",
    "link.non_posix_path": "Write paths with forward slashes.",
    "graph.missing_decision_link": "State what the decision depends on, replaces or links to.",
}
DEFINING = ("design", "adr", "api", "runbook", "spec")
GENERATED = ("node_modules", "dist", "build", "coverage", ".next", ".cache", "tmp", "temp", "vendor")
HIGH_DEGREE, OVERSIZED_BYTES = 50, 100 * 1024 * 1024


@dataclass(frozen=True)
class Scope:
    """mode: all, changed or since; the paths that a diff names."""

    mode: str = "all"
    changed: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    untracked: tuple[str, ...] = ()
    base: str | None = None

    def paths(self) -> set[str]:
        return {p.replace("\\", "/") for p in (*self.changed, *self.deleted, *self.untracked, *(x for r in self.renamed for x in r))}


@dataclass
class Report:
    warnings: DataFrame
    stale: DataFrame
    is_stale: bool
    scope: Scope
    parts: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> dict[str, int]:
        return {r["code"]: r["count"] for r in self.warnings.groupBy("code").count().collect()}  # one row a code


def warning(df: DataFrame, code: str, path: Column, message: Column, line: Column | None = None, label: Column | None = None, evidence: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), path.cast("string").alias("path"), (F.lit(None) if line is None else line).cast("int").alias("line"),
        (F.lit(None) if label is None else label).cast("string").alias("label"), message.alias("message"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"), F.lit(REMEDY[code]).alias("remediation"),
    )


def ordered(warnings: DataFrame) -> DataFrame:
    """By severity, code, place and message, compared as one text."""
    rank = F.create_map(*[F.lit(x) for p in zip(("error", "warn", "info"), "012") for x in p])
    return warnings.orderBy(F.concat_ws("|", rank[F.col("severity")], "code", F.coalesce("path", "label", F.lit("")), F.coalesce("line", F.lit(0)), "message"), "evidence")


def stale_index(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """path, reason (added, id_changed, modified, deleted); files that can't be parsed are not deleted."""
    now = parsed.select("path", F.col("id").alias("id1"), F.col("hash").alias("hash1"), F.col("error").isNotNull().alias("failed"), F.lit(True).alias("is"))
    was = documents.select("path", F.col("id").alias("id0"), F.col("hash").alias("hash0"), F.lit(True).alias("was"))
    both = now.join(was, "path", "full_outer").where(~F.coalesce(F.col("failed"), F.lit(False)))
    reason = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("id0") != F.col("id1"), "id_changed").when(F.col("hash0") != F.col("hash1"), "modified")
    return both.select("path", reason.alias("reason"), F.col("id0").alias("indexed_id"), F.col("id1").alias("current_id"), F.col("hash0").alias("indexed_hash"), F.col("hash1").alias("current_hash")).where("reason IS NOT NULL")


def status_of(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("state", F.lower(trim(F.coalesce(F.col("front.status"), F.lit("active")))))


def document_links(g: GraphTables) -> DataFrame:
    """document_id, raw, exact, definitions and the document's own columns."""
    parts = (
        g.documents.select(F.col("id").alias("document_id"), "id", F.lit("document").alias("part"))
        .union(g.sections.select("document_id", "id", F.lit("section"))).union(g.chunks.select("document_id", "id", F.lit("chunk")))
    )
    return graph.link_stats(parts, g.edges).join(g.documents.withColumnRenamed("id", "document_id"), "document_id")


def orphans(stats: DataFrame) -> DataFrame:
    return stats.where("raw = 0")


def weakly_linked(stats: DataFrame) -> DataFrame:
    return stats.where("raw > 0 AND raw < 2")


def missing_definitions(stats: DataFrame) -> DataFrame:
    """Documents of kinds that should define something, and don't."""
    return stats.where(F.col("type").isin(list(DEFINING)) & (F.col("definitions") == 0))


def contradictions(g: GraphTables, config: Config) -> DataFrame:
    """entity_id, paths, name, normalized_name of entities that several active documents define."""
    stop = [s.lower() for s in config.stop_entities]
    defining = g.edges.where("kind = 'DEFINES'").select(F.col("from_id").alias("id"), F.col("to_id").alias("entity_id")).join(owners(g), "id")
    active = g.documents.where("status = 'active'").select(F.col("id").alias("document_id"), "path")
    twice = graph.definition_collisions(defining.join(active, "document_id").select("entity_id", "path"))
    return twice.join(g.entities.select(F.col("id").alias("entity_id"), "name", "normalized_name"), "entity_id").where(~F.col("normalized_name").isin(stop))


def lifecycle(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, line, raw, code, replaced_by: active documents that link to deprecated or superseded ones."""
    docs = status_of(parsed).select(F.col("id").alias("target_id"), F.col("path").alias("target"), F.col("state").alias("target_state"), (F.size("front.deprecated_by") > 0).alias("replaced"))
    sources = status_of(parsed).where("state = 'active'").select(F.col("id").alias("from_id"), F.col("path").alias("source"))
    refs = front_references(parsed, ["deprecated_by", "supersedes"]).where("target_id IS NOT NULL AND target_id <> from_id")
    target_path = docs.select("target_id", F.col("target").alias("to_path"))
    by = refs.where("field = 'deprecated_by'").join(target_path, "target_id").select(F.col("from_id").alias("target_id"), F.col("to_path").alias("by"))
    newer = refs.where("field = 'supersedes'").join(sources.select("from_id"), "from_id", "left_semi").select("target_id", F.col("from_path").alias("by"), F.lit(True).alias("super"))
    by = by.withColumn("super", F.lit(False)).unionByName(newer)
    replaced = by.groupBy("target_id").agg(F.sort_array(F.collect_set("by")).alias("replaced_by"), F.max("super").alias("super"))
    rows = links.where("target_id IS NOT NULL AND target_id <> from_id").join(sources, "from_id").join(docs, "target_id").join(replaced, "target_id", "left")
    old = (F.col("target_state") == "superseded") | F.col("replaced") | F.coalesce(F.col("super"), F.lit(False))
    codes = F.array_compact(F.array(F.when(F.col("target_state") == "deprecated", F.lit("document.deprecated_referenced")), F.when(old, F.lit("document.superseded_referenced"))))
    return rows.select("source", "target", "line", "raw", F.explode(codes).alias("code"), "replaced_by")


def high_degree(g: GraphTables, limit: int = 10) -> DataFrame:
    top = graph.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(limit)
    return top.join(all_nodes(g).select("id", "kind", "label"), "id")


def path_groups(g: GraphTables) -> DataFrame:
    """path_group, documents, chunks, content_bytes: roll-up to the first folder ('.' for files of the root)."""
    per = g.chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))
    rows = g.documents.join(per, "id", "left").select(F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".").alias("path_group"), (F.octet_length("path") + F.coalesce("chars", F.lit(0))).alias("bytes"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return rows.groupBy("path_group").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("content_bytes")).orderBy(F.desc("content_bytes"), "path_group")


def vector_profiles(g: GraphTables) -> DataFrame:
    """provider, model, dimensions, vectors, invalid: vectors by kind; invalid ones have another length, or nothing or no number in them."""
    v = F.col("vector")
    sound = (F.size(v) == F.col("dimensions")) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return g.chunk_vectors.groupBy("provider", "model", "dimensions").agg(F.count(F.lit(1)).alias("vectors"), F.sum((~F.coalesce(sound, F.lit(False))).cast("bigint")).alias("invalid"))


def storage_warnings(g: GraphTables, total_bytes: int | None = None) -> DataFrame:
    groups = path_groups(g).where(F.col("path_group").isin(list(GENERATED)))
    out = warning(groups, "storage.generated_path_indexed", F.col("path_group"), F.concat(F.lit("A folder of generated files is indexed: "), "path_group"), evidence=F.to_json(F.struct("documents", "chunks", "content_bytes")))
    hubs = high_degree(g).where(F.col("degree") >= HIGH_DEGREE)
    out = out.union(warning(hubs, "storage.high_degree_node", F.lit(None), F.concat(F.lit("A node with very many edges: "), "label"), label=F.col("label"), evidence=F.to_json(F.struct("id", "kind", "degree"))))
    n = g.chunk_vectors.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(g.chunks.agg(F.count(F.lit(1)).alias("chunks")))  # one row each
    out = out.union(warning(n.where("vectors > 0 AND vectors <> chunks"), "storage.vector_anomaly", F.lit(None), F.lit("There are not as many vectors as chunks."), label=F.lit("vectors"), evidence=F.to_json(F.struct("vectors", "chunks"))))
    if total_bytes is not None and total_bytes > OVERSIZED_BYTES:
        one = g.documents.sparkSession.range(1)
        out = out.union(warning(one, "storage.oversized", F.lit(None), F.lit(f"The index takes {total_bytes} bytes."), label=F.lit("index")))
    return out


def scope_paths(g: GraphTables, scope: Scope) -> DataFrame:
    """path: the scope's documents and those an edge away."""
    spark = g.documents.sparkSession
    base = spark.createDataFrame([(p,) for p in sorted(scope.paths())], "path string")
    own = owners(g)
    docs = g.documents.select(F.col("id").alias("document_id"), "path").join(F.broadcast(base), "path", "left_semi")  # the paths of a diff
    touched = own.join(docs.select("document_id"), "document_id", "left_semi").select(F.col("id").alias("node"))
    ends = g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(g.edges.select("to_id", "from_id"))
    near = ends.join(touched, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("id")).join(own, "id").join(g.documents.select(F.col("id").alias("document_id"), "path"), "document_id")
    return base.union(near.select("path")).distinct()


def run_doctor(parsed: DataFrame, g: GraphTables, config: Config | None = None, files: DataFrame | None = None, scope: Scope | None = None) -> Report:
    """``parsed``: the project as it is; ``g``: as it was indexed; ``files``: path of every file, for source references.

    A stale index is reported alone with the files that can't be parsed.
    """
    config, scope = config or Config(), scope or Scope()
    stale = stale_index(parsed, g.documents)
    near = None if scope.mode == "all" else scope_paths(g, scope)
    within = lambda df, path="path": df if near is None else df.join(near.select(F.col("path").alias("__in")), F.col(path) == F.col("__in"), "left_semi")
    stale = within(stale)
    failed = parsed.where("error IS NOT NULL")
    failures = warning(failed, "document.parse_failed", F.col("path"), F.concat(F.lit("The file can't be parsed: "), "error"))
    is_stale = not stale.isEmpty()
    if is_stale:
        told = warning(stale, "index.stale", F.col("path"), F.concat(F.lit("The index is stale: "), "path", F.lit(" was "), "reason"))
        return Report(ordered(told.union(failures)), stale, True, scope, {"stale": stale})
    good = parsed.where("error IS NULL")
    mine = within(good)
    links = materialize(all_links(good))  # four checks read them
    stats = materialize(within(document_links(g)))
    dead = within(links.where("node_id IS NULL").where((F.col("kind") == "wikilink") | is_local_document(F.col("raw"))), "from_path")
    orphan, weak, undefined = orphans(stats), weakly_linked(stats), missing_definitions(stats)
    twice = contradictions(g, config)
    if near is not None:
        listed = twice.select("entity_id", F.explode("paths").alias("path"))
        twice = twice.join(within(listed).select("entity_id").distinct(), "entity_id", "left_semi")
    risks = content_risks(mine)
    diagnostics = mine.select("path", F.inline("diagnostics"))
    tags = mine.select("path", F.explode(F.array_distinct("front.tags")).alias("tag")).where(~F.col("tag").rlike("^[a-z0-9][a-z0-9._/-]*$"))
    slashes = mine.select("path", F.inline("links")).where(is_local_document(F.col("url")) & F.col("url").contains("\\"))
    aged = lifecycle(good, links)
    if near is not None:
        aged = within(aged, "source").union(within(aged, "target")).distinct()
    local = F.exists("links", lambda x: is_local_document(x["url"]))
    alone = status_of(mine).where("front.type = 'adr' AND state = 'active'").where(~(local | (F.size("wiki_links") > 0) | (F.size("front.depends_on") > 0) | (F.size("front.supersedes") > 0) | (F.size("front.deprecated_by") > 0)))
    path = F.col("path")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    checks = [
        failures,
        *[warning(diagnostics.where(F.col("code") == c), c, path, F.col("message"), F.col("line")) for c in SEVERITY if c.startswith("front_matter.")],
        warning(tags, "tag.invalid_format", path, say("The tag isn't a lower-case slug: ", F.col("tag"))),
        warning(slashes, "link.non_posix_path", path, say("A local link has backslashes: ", F.col("url")), F.col("line")),
        *[warning(aged.where(F.col("code") == c), c, F.col("source"), say("An active document links to ", F.col("target"), F.when(F.size("replaced_by") > 0, say(", replaced by ", F.array_join("replaced_by", ", "))).otherwise(F.lit(""))), F.col("line")) for c in ("document.deprecated_referenced", "document.superseded_referenced")],
        warning(alone, "graph.missing_decision_link", path, say("An active decision has no relations or links: ", path)),
        warning(dead, "link.dead", F.col("from_path"), say("The link leads nowhere: ", F.col("raw")), F.col("line"), evidence=F.col("kind")),
        warning(undefined, "definition.missing", path, say("The document defines nothing: ", path)),
        warning(twice, "definition.duplicate", F.lit(None), say(F.col("name"), " is defined by ", F.array_join("paths", ", ")), label=F.col("name")),
        warning(risks, "content.risk", F.col("id"), F.col("reason"), F.col("line")),
        warning(orphan, "document.orphan", path, say("No edge leads to or from ", path)),
        warning(weak, "document.weakly_linked", path, say("Only one edge leads to or from ", path)),
    ]
    if near is None:
        checks.append(storage_warnings(g))
    elif scope.deleted:
        gone = g.documents.sparkSession.createDataFrame([(p,) for p in scope.deleted], "path string")
        checks.append(warning(gone, "document.deleted", path, say("The document was deleted: ", path)))
    parts = {"orphans": orphan, "weakly_linked": weak, "dead_links": dead, "missing_definitions": undefined, "contradictions": twice, "content_risks": risks, "lifecycle": aged, "missing_decision_links": alone}
    if files is not None:
        parts["missing_sources"] = missing_sources(good, g, files, within)
        checks.append(parts["missing_sources"])
    all_of = checks[0]
    for c in checks[1:]:
        all_of = all_of.union(c)
    return Report(ordered(all_of), stale, False, scope, parts)


def missing_sources(parsed: DataFrame, g: GraphTables, files: DataFrame, within) -> DataFrame:
    """Source references whose file isn't there, or lies outside the project."""
    outside = F.col("path").rlike(r"^(?:/|[A-Za-z]:)") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    there = files.select(F.col("path").alias("__file"))
    lost = g.source_refs.join(there, F.col("path") == F.col("__file"), "left_anti").withColumn("outside", outside)
    named = F.concat("front.implements", "front.source_refs")
    by = parsed.select(F.col("path").alias("document"), F.explode(F.transform(named, lambda v: F.lower(posix(trim(v))))).alias("normalized_path"))
    docs = within(by, "document").groupBy("normalized_path").agg(F.sort_array(F.collect_set("document")).alias("documents"))
    rows = lost.join(docs, "normalized_path", "inner")
    where = F.when(F.col("outside"), F.lit("outside the project")).otherwise(F.lit("not found"))
    return warning(rows, "source_ref.missing", F.element_at("documents", 1), F.concat(F.lit("The source file is "), where, F.lit(": "), "path"), label=F.col("path"), evidence=F.array_join("documents", ", "))


def health_states(report: Report, g: GraphTables) -> DataFrame:
    """document_id, state for the filter language."""
    p = report.parts
    by_id = lambda df, c, state: df.select(F.col(c).alias("document_id"), F.lit(state).alias("state"))
    by_path = lambda df, path, state: df.select(path.alias("path"), F.lit(state).alias("state"))
    at = by_path(p["contradictions"], F.explode("paths"), "possible_contradiction").union(by_path(p["content_risks"], F.col("id"), "content_risk"))
    if "missing_sources" in p:
        at = at.union(by_path(p["missing_sources"], F.explode(F.split("evidence", ", ")), "stale_source_ref"))
    placed = at.join(g.documents.select(F.col("id").alias("document_id"), "path"), "path").select("document_id", "state")
    return (
        by_id(p["orphans"], "document_id", "orphan").union(by_id(p["weakly_linked"], "document_id", "weakly_linked")).union(by_id(p["dead_links"], "from_id", "dead_link"))
        .union(by_id(p["missing_definitions"], "document_id", "missing_definition")).union(placed).distinct()
    )


def gate(report: Report, fail_on: str | None = None, strict: bool = False) -> int:
    """Exit code: 1 where a warning of ``fail_on`` or worse, or with ``strict`` any, was given."""
    order = ["error", "warn", "info"]
    worst = order if strict else order[: order.index(fail_on) + 1] if fail_on else []
    return int(bool(worst) and not report.warnings.where(F.col("severity").isin(worst)).isEmpty())
