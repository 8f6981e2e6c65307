"""Property-graph operators over an edge table (from_id, to_id, kind, weight, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_kind_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight"), 6).alias("avg_weight"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def degrees(edges: DataFrame, contains: str = "CONTAINS") -> DataFrame:
    """id, degree over both ends of all but containment edges; a loop counts twice."""
    plain = edges.where(F.col("kind") != contains)
    return plain.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def document_frequency(edges: DataFrame, owner: DataFrame, contains: str = "CONTAINS") -> DataFrame:
    """id, documents: distinct owners (id, document_id) on the other side of an entity's edges, in both directions."""
    plain = edges.where(F.col("kind") != contains)
    sides = plain.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).union(plain.select("to_id", "from_id"))
    owned = sides.join(owner.withColumnRenamed("id", "other"), "other")
    return owned.groupBy("id").agg(F.countDistinct("document_id").alias("documents"))


def link_stats(doc_parts: DataFrame, edges: DataFrame) -> DataFrame:
    """document_id, raw, exact, definitions: edges that touch a document.

    ``doc_parts``: document_id, id, part ('document', 'section' or 'chunk').
    ``raw`` counts an edge once for each (section, chunk) row in which an end
    of it is the document, that section or that chunk: with S sections and C
    chunks S*C for the document's own, C for a section's, S for a chunk's.
    ``exact`` counts each edge once.
    """
    sizes = doc_parts.groupBy("document_id").agg(
        F.greatest(F.lit(1), F.sum((F.col("part") == "section").cast("int"))).alias("s"), F.greatest(F.lit(1), F.sum((F.col("part") == "chunk").cast("int"))).alias("c")
    )
    plain = edges.where((F.col("kind") != "CONTAINS") & (F.coalesce(F.col("provenance"), F.lit("")) != "embedding_similarity"))
    ends = plain.select("id", "kind", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("end"))
    own = ends.join(doc_parts.select("document_id", F.col("id").alias("end"), "part"), "end")
    n = lambda p: F.sum((F.col("part") == p).cast("int"))
    touched = own.groupBy("document_id", "id").agg(F.first("kind").alias("kind"), n("document").alias("d"), n("section").alias("x"), n("chunk").alias("y"))
    s, c = F.col("s"), F.col("c")
    times = F.when(F.col("d") > 0, s * c).otherwise(s * c - (s - F.col("x")) * (c - F.col("y")))
    counted = touched.join(sizes, "document_id").groupBy("document_id").agg(
        F.sum(times).alias("raw"), F.count(F.lit(1)).alias("exact"), F.sum(F.when(F.col("kind") == "DEFINES", times).otherwise(0)).alias("definitions")
    )
    return sizes.select("document_id").join(counted, "document_id", "left").na.fill(0)


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int, target: str | None = None) -> DataFrame:
    """id, depth, parent: fewest hops from ``sources`` (id), edges read both ways.

    One join a level against the adjacency; the visited set grows by an anti
    join and is checkpointed reliably so the plan doesn't grow with depth.
    Of several parents the one over the heaviest, most confident edge counts.
    """
    from ..session import materialize

    both = edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y"), "weight", "confidence").union(edges.select("to_id", "from_id", "weight", "confidence"))
    seen = materialize(sources.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["id"]))
    frontier = seen
    for depth in range(1, max_depth + 1):
        order = F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("x").alias("x"))
        step = both.join(frontier.select(F.col("id").alias("x")), "x").groupBy(F.col("y").alias("id")).agg(F.min(order).alias("via"))
        fresh = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("via.x").cast("string").alias("parent"))
        frontier = materialize(fresh)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if target is not None and not frontier.where(F.col("id") == target).isEmpty():
            break
    return seen


def definition_collisions(definitions: DataFrame) -> DataFrame:
    """entity_id, paths: entities defined by more than one document (entity_id, path)."""
    return definitions.groupBy("entity_id").agg(F.sort_array(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def shortest_path(edges: DataFrame, start: str, target: str, max_depth: int) -> list | None:
    """The edges of a path of fewest hops, read both ways; None where there is none within ``max_depth``.

    Of several, the one whose edges are heaviest, then most confident, from
    the start on.  A level is a join and a group-by; each reached node carries
    its path, so no order over a whole level is needed.
    """
    from ..session import materialize

    if start == target:
        return []
    step = "struct<w: double, c: double, edge: string, a: string, b: string>"
    own = lambda a, b: F.struct((-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), F.col("id").alias("edge"), F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y"), own("from_id", "to_id").alias("s")).union(edges.select("to_id", "from_id", own("to_id", "from_id")))
    frontier = materialize(edges.sparkSession.createDataFrame([(start,)], "x string").withColumn("path", F.array().cast(f"array<{step}>")))
    seen = frontier.select("x")
    for _ in range(max_depth):
        reached = both.join(frontier, "x").groupBy("y").agg(F.min(F.concat("path", F.array("s"))).alias("path"))
        fresh = reached.join(seen.withColumnRenamed("x", "y"), "y", "left_anti")
        frontier = materialize(fresh.withColumnRenamed("y", "x"))
        hit = frontier.where(F.col("x") == target).head(1)
        if hit:
            return hit[0]["path"]
        if frontier.isEmpty():
            return None
        seen = seen.union(frontier.select("x"))
    return None
