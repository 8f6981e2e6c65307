"""Related documents from chunk vectors: centroids, evidence, mutual neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.vectors import bounded_dot
from ..model import EDGE_WEIGHTS, Config, GraphTables
from ..session import materialize
from .ranking import even_sample
from .relate import centroids, reciprocal, similar_pairs

MAX_PAIRS, MAX_VECTOR_PAIRS, MAX_COMPONENTS = 250_000, 2_000_000, 100_000_000
SAMPLE, MARGIN, ALGORITHM = 12, 0.12, "mutual-neighbours-v1"
#: Providers whose vectors carry no meaning.
NOT_SEMANTIC = frozenset({"local-hash"})


class DerivationError(Exception):
    """code: invalid_options, embedding_disabled, provider_not_semantic, stale_index, incomplete_vector_coverage or corpus_too_large."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Options:
    threshold: float = 0.86
    neighbours: int = 3
    evidence: int = 2

    def __post_init__(self) -> None:
        if not 0.75 <= self.threshold <= 1 or not 1 <= self.neighbours <= 10 or not 2 <= self.evidence <= 4:
            raise DerivationError("invalid_options", "threshold goes from 0.75 to 1, neighbours from 1 to 10, evidence from 2 to 4")


@dataclass(frozen=True)
class Derivation:
    """pairs: a, b (document ids), a_path, b_path, confidence, evidence; edges: both directions of each."""

    pairs: DataFrame
    edges: DataFrame
    eligible: int
    document_pairs: int
    vector_pairs: int


def _valid(g: GraphTables, config: Config) -> DataFrame:
    v = F.col("vector")
    sound = (F.size(v) == config.dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return g.chunk_vectors.where((F.col("provider") == config.provider) & (F.col("model") == config.embedding_model) & (F.col("dimensions") == config.dimensions) & sound)


def independent(pairs: list[tuple[float, str, str]], most: int) -> list[tuple[float, str, str]]:
    """The most similar pairs, no chunk twice; ties by the chunks' ids."""
    used_a, used_b, out = set(), set(), []
    for s, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in used_a and b not in used_b:
            out.append((s, a, b))
            used_a.add(a)
            used_b.add(b)
            if len(out) == most:
                break
    return out


_EVIDENCE = "array<struct<similarity: double, a_chunk: string, b_chunk: string>>"


def _matches(options: Options):
    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = independent(list(zip(pdf["s"], pdf["ca"], pdf["cb"])), max(options.evidence, 4))
        if len(found) < options.evidence:
            return pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "confidence": pd.Series(dtype=float), "evidence": pd.Series(dtype=object)})
        confidence = round(float(np.mean([f[0] for f in found[: options.evidence]])), 6)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "confidence": [confidence], "evidence": [[{"similarity": float(s), "a_chunk": x, "b_chunk": y} for s, x, y in found]]})

    return match


def derive_related(g: GraphTables, config: Config, options: Options | None = None, created_at: str = "", stale: bool = False) -> Derivation:
    """Pairs of documents that are each among the other's nearest, by several independent pairs of chunks.

    The budgets of work come first, so that a corpus that is too large fails
    before any pair is made.
    """
    options = options or Options()
    if not config.semantic:
        raise DerivationError("embedding_disabled", "vectors are switched off in the settings")
    if config.provider in NOT_SEMANTIC:
        raise DerivationError("provider_not_semantic", f"the vectors of {config.provider} say nothing of meaning")
    if stale:
        raise DerivationError("stale_index", "the index is stale or holds files that can't be parsed")
    valid = _valid(g, config)
    counts = (valid.count(), g.chunks.count(), g.chunk_vectors.count())
    if len(set(counts)) > 1:
        raise DerivationError("incomplete_vector_coverage", f"{counts[0]} valid vectors of {counts[2]} for {counts[1]} chunks")
    place = g.sections.select(F.col("id").alias("section_id"), "start_line")
    path = g.documents.select(F.col("id").alias("document_id"), "path")
    chunks = valid.select(F.col("chunk_id").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v")).join(g.chunks.select("id", "document_id", "section_id"), "id").join(place, "section_id", "left").join(path, "document_id")
    enough = chunks.groupBy("document_id").count().where(F.col("count") >= options.evidence).select("document_id")
    chunks = even_sample(chunks.join(enough, "document_id", "left_semi"), "document_id", [F.col("start_line").asc_nulls_first(), F.col("id")], SAMPLE)
    centroid = materialize(centroids(chunks, "path", "v"))
    eligible = centroid.count()
    pairs = eligible * (eligible - 1) // 2
    if pairs > MAX_PAIRS or pairs * config.dimensions > MAX_COMPONENTS:
        raise DerivationError("corpus_too_large", f"{pairs} pairs of documents are more than the budget of {MAX_PAIRS} pairs or {MAX_COMPONENTS} components allows")
    near = similar_pairs(centroid, "path", max(0.0, options.threshold - MARGIN)).select(F.col("a").alias("a_path"), F.col("b").alias("b_path"))
    near = near.join(path.select(F.col("document_id").alias("a"), F.col("path").alias("a_path")), "a_path").join(path.select(F.col("document_id").alias("b"), F.col("path").alias("b_path")), "b_path")
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    work = near.join(n.select(F.col("document_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("document_id").alias("b"), F.col("n").alias("nb")), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0))).first()[0]
    if work > MAX_VECTOR_PAIRS or work * config.dimensions > MAX_COMPONENTS:
        raise DerivationError("corpus_too_large", f"{work} pairs of vectors are more than the budget allows")
    left = chunks.select(F.col("document_id").alias("a"), F.col("id").alias("ca"), F.col("v").alias("va"))
    right = chunks.select(F.col("document_id").alias("b"), F.col("id").alias("cb"), F.col("v").alias("vb"))
    alike = near.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", F.round(bounded_dot(F.col("va"), F.col("vb")), 6).alias("s")).where(F.col("s") >= options.threshold)
    candidates = alike.groupBy("a", "b").applyInPandas(_matches(options), f"a string, b string, confidence double, evidence {_EVIDENCE}")
    paths = path.select(F.col("document_id").alias("a"), F.col("path").alias("a_path"))
    named = candidates.join(paths, "a").join(path.select(F.col("document_id").alias("b"), F.col("path").alias("b_path")), "b")
    best = reciprocal(named.select(F.col("a_path").alias("a"), F.col("b_path").alias("b"), "confidence"), options.neighbours, "confidence")
    mutual = named.join(best.select(F.col("a").alias("a_path"), F.col("b").alias("b_path")), ["a_path", "b_path"], "left_semi")
    return Derivation(mutual, related_edges(mutual, config, options, created_at), eligible, pairs, int(work))


def related_edges(pairs: DataFrame, config: Config, options: Options, created_at: str) -> DataFrame:
    turned = F.transform("evidence", lambda e: F.struct(e["similarity"].alias("similarity"), e["b_chunk"].alias("a_chunk"), e["a_chunk"].alias("b_chunk")))
    both = pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "confidence", "evidence").union(pairs.select("b", "a", "confidence", turned))
    about = {"provider": config.provider, "model": config.embedding_model, "dimensions": config.dimensions, "algorithm": ALGORITHM, "threshold": options.threshold, "neighbours": options.neighbours, "minEvidence": options.evidence, "symmetric": True}
    fields = [F.lit(v).alias(k) for k, v in about.items()]
    return both.select(
        stable_id("edge", F.concat(F.col("from_id"), F.lit(":RELATED_TO:"), F.col("to_id"), F.lit(":embedding_similarity"))).alias("id"), "from_id", "to_id", F.lit("RELATED_TO").alias("kind"),
        F.lit(EDGE_WEIGHTS["RELATED_TO"]).alias("weight"), "confidence", F.lit("embedding_similarity").alias("provenance"), F.to_json(F.struct(*fields, F.col("evidence"))).alias("metadata_json"), F.lit(created_at).alias("created_at"),
    )


def replace_derived(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """All derived edges are replaced by ``derived``; the others stay."""
    return edges.where("NOT (kind = 'RELATED_TO' AND provenance <=> 'embedding_similarity')").unionByName(derived)


