"""Differences between two snapshots of a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash
from ..model import Config, GraphTables
from ..sources.store import counts
from .relate import symmetric_difference


def source_hash(documents: DataFrame, config: Config | None = None) -> str:
    """A hash of the sorted hashes of paths and contents, and of the settings.

    Documents are hashed in the JVM and folded by sorted buckets, so what
    reaches the driver is a row for each of 256 buckets.
    """
    pair = F.sha2(F.concat_ws("\n", "path", "hash"), 256)
    buckets = documents.select(pair.alias("h")).groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    settings = {k: v for k, v in (config or Config()).__dict__.items()}
    return canonical_hash({"documents": {r["b"]: r["h"] for r in buckets.collect()}, "settings": settings})


@dataclass(frozen=True)
class GraphDiff:
    documents: DataFrame
    source_refs: DataFrame
    warnings: DataFrame | None
    deltas: dict[str, int]

    def summary(self) -> dict[str, int]:
        found = {r["change"]: r["count"] for r in self.documents.groupBy("change").count().collect()}  # four rows
        return {k: found.get(k, 0) for k in ("added", "modified", "deleted", "renamed")} | self.deltas


def _sized(g: GraphTables) -> DataFrame:
    """Documents with their numbers of sections and referenced sources."""
    s = g.sections.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("sections"))
    r = g.edges.where("kind = 'REFERENCES_SOURCE'").join(g.source_refs.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return g.documents.select("id", "path", "hash", "status", "type").join(s, "id", "left").join(r, "id", "left").na.fill(0, ["sections", "refs"]).drop("id")


def diff_documents(base: GraphTables, head: GraphTables, renames: dict[str, str] | None = None) -> DataFrame:
    """path, previous_path, change, hash_changed, status_changed, section_delta, source_ref_delta; renames are matched first."""
    a, b = _sized(base), _sized(head)
    spark = base.documents.sparkSession
    moved = spark.createDataFrame(sorted((renames or {}).items()), "old string, new string")  # the renames of a diff
    there = moved.join(a.select(F.col("path").alias("old")), "old", "left_semi").join(b.select(F.col("path").alias("new")), "new", "left_semi")
    left = a.join(F.broadcast(there), a["path"] == there["old"], "left").select(F.coalesce("new", "path").alias("key"), F.col("new").isNotNull().alias("moved"), *[F.col(c).alias(f"a_{c}") for c in a.columns])
    taken = b.join(F.broadcast(there.select(F.col("new").alias("path"), F.lit(True).alias("target"))), "path", "left")
    right = taken.select(F.col("path").alias("key"), F.coalesce("target", F.lit(False)).alias("moved"), *[F.col(c).alias(f"b_{c}") for c in b.columns])
    both = left.join(right, ["key", "moved"], "full_outer")
    was, now = F.col("a_path").isNotNull(), F.col("b_path").isNotNull()
    differ = (F.col("a_hash") != F.col("b_hash")) | (F.col("a_status") != F.col("b_status")) | (F.col("a_type") != F.col("b_type"))
    change = F.when(~was, "added").when(~now, "deleted").when(F.col("moved"), "renamed").when(differ, "modified")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = both.withColumn("change", change).where("change IS NOT NULL")
    return rows.select(
        F.col("key").alias("path"), F.when(F.col("change") == "renamed", F.col("a_path")).alias("previous_path"), "change",
        F.when(was & now, F.col("a_hash") != F.col("b_hash")).otherwise(F.lit(True)).alias("hash_changed"), F.when(was & now, F.col("a_status") != F.col("b_status")).alias("status_changed"),
        (n("b_sections") - n("a_sections")).alias("section_delta"), (n("b_refs") - n("a_refs")).alias("source_ref_delta"),
    ).orderBy(F.coalesce("previous_path", "path"), "path")


def count_delta(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """key, delta of the numbers of rows, without zeros."""
    both = base.select(key, F.lit(-1).alias("n")).union(head.select(key, F.lit(1)))
    return both.groupBy(key).agg(F.sum("n").alias("delta")).where("delta <> 0")


def graph_diff(base: GraphTables, head: GraphTables, renames: dict[str, str] | None = None, base_warnings: DataFrame | None = None, head_warnings: DataFrame | None = None) -> GraphDiff:
    a, b = base.source_refs.select("path").distinct(), head.source_refs.select("path").distinct()
    refs = symmetric_difference(a, b).orderBy("path")
    warned = None if base_warnings is None or head_warnings is None else count_delta(base_warnings, head_warnings, "code")
    was, now = counts(base), counts(head)
    return GraphDiff(diff_documents(base, head, renames), refs, warned, {k: now[k] - was[k] for k in ("sections", "source_refs", "edges")})
