"""Search: definitions, full text and vectors, fused by reciprocal rank."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_prefixes
from ..functions.vectors import EmbeddingError, cosine, provider
from ..model import Config, GraphTables
from ..session import few, materialize
from . import fts, graph
from .nodes import owners
from .ranking import fuse, top_per_group
from .resolve import first_by

TRUST = {"validated": 8.0, "authored": 5.0, "generated": -5.0, "external": -10.0, "untrusted": -30.0}
STATUS = {"deprecated": -20.0, "superseded": -20.0, "draft": -8.0, "archived": -8.0}
_QUERY_NAME = re.compile(r"`([^`]+)`|(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_.]+(?![A-Za-z0-9_])|/[A-Za-z0-9_./:{}-]+")
MODES = ("auto", "keyword", "semantic")


def query_entities(query: str) -> list[str]:
    """What a query seems to name: quoted by backticks, capitalised or a path."""
    return [n for m in _QUERY_NAME.finditer(query) if (n := m[0].removeprefix("`").removesuffix("`").strip())]


@dataclass(frozen=True)
class SearchRun:
    """results: a DataFrame of at most ``limit`` rows; the rest explains how they came about."""

    results: DataFrame
    query: str
    limit: int
    mode: str
    candidates: list[str]
    matched: list[dict]
    prefixes: list[str]
    semantic_requested: bool
    semantic_provider: str | None
    diagnostic: dict | None


def wants_vectors(config: Config, mode: str, semantic: bool | None) -> tuple[str, bool]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    mode = "semantic" if semantic and mode == "auto" else mode
    return mode, mode == "semantic" or (mode == "auto" and (config.semantic if semantic is None else semantic))


def query_vector(g: GraphTables, config: Config, query: str) -> list[float]:
    """The query's vector; raises EmbeddingError unless every chunk has one of the same kind."""
    profile = (F.col("provider") == config.provider) & (F.col("model") == config.embedding_model) & (F.col("dimensions") == config.dimensions)
    have, need = g.chunk_vectors.where(profile).count(), g.chunks.count()
    if not need or have != need:
        raise EmbeddingError("vectors_unavailable", f"{have} of {need} chunks have vectors of {config.provider}/{config.embedding_model}/{config.dimensions}")
    return provider(config.provider, config.embedding_model, config.dimensions)([query])[0]


def _matched(g: GraphTables, config: Config, names: list[str]) -> list[dict]:
    """Entities that the query names, in its order, with their document frequency."""
    if not names:
        return []
    asked = g.entities.sparkSession.createDataFrame([(i, n.lower().strip()) for i, n in enumerate(names)], "pos int, normalized_name string")
    rows = g.entities.join(F.broadcast(asked), "normalized_name").select("pos", "id", "name", "normalized_name", "kind")
    found = [r.asDict() for r in rows.orderBy("pos", "kind", "id").collect()]  # the query's names
    if not found:
        return []
    ids = list({r["id"] for r in found})
    own = materialize(g.edges.where("kind <> 'CONTAINS'").where(F.col("from_id").isin(ids) | F.col("to_id").isin(ids)))
    ends = few(own.select(F.col("from_id").alias("id")).union(own.select("to_id")).distinct())
    df = {r["id"]: r["documents"] for r in graph.document_frequency(own, owners(g).join(ends, "id", "left_semi")).where(F.col("id").isin(ids)).collect()}
    return [r | {"documents": df.get(r["id"], 0)} for r in found]


def _definitions(g: GraphTables, matched: list[dict]) -> DataFrame:
    """Up to three definitions of each entity: node, content, base, rank."""
    spark = g.edges.sparkSession
    asked = spark.createDataFrame([(i, m["id"]) for i, m in enumerate(matched)], "pos int, to_id string")
    s = g.sections.select(F.col("id").alias("section_id"), F.col("document_id").alias("owner"), "start_line")
    e = few(g.edges.where("kind = 'DEFINES'").join(F.broadcast(asked), "to_id"))
    s = s.join(e.select(F.col("from_id").alias("section_id")), "section_id", "left_semi")
    rows = e.join(s, e["from_id"] == s["section_id"], "left").withColumn("document_id", F.coalesce("owner", "from_id"))
    rows = rows.join(g.documents.select(F.col("id").alias("document_id"), "path"), "document_id")
    top = materialize(top_per_group(rows, ["pos"], [F.desc("weight"), F.col("path"), F.col("start_line").asc_nulls_first(), F.col("id")], 3, "n"))
    asked_for = lambda df, c, key: df.join(F.broadcast(top.select(F.col(key).alias(c))), c, "left_semi")  # noqa: E731  three rows a name
    c = g.chunks.select(F.col("id").alias("cid"), F.col("document_id").alias("cd"), F.col("section_id").alias("cs"), "content")
    by_section = first_by(asked_for(c, "cs", "section_id"), ["cs"], [F.col("cid")]).select(F.col("cs").alias("section_id"), F.col("content").alias("own"))
    by_document = first_by(asked_for(c, "cd", "document_id"), ["cd"], [F.col("cid")]).select(F.col("cd").alias("document_id"), F.col("content").alias("any"))
    full = top.join(by_section, "section_id", "left").join(by_document, "document_id", "left")
    return full.select("document_id", "section_id", F.coalesce("own", "any").alias("content"), (200 + F.col("weight")).alias("base"), F.struct("pos", "n").alias("place"))


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def search(g: GraphTables, query: str, config: Config | None = None, limit: int | None = None, mode: str = "auto", semantic: bool | None = None) -> SearchRun:
    """The best sections for a query.

    Each channel gives at most twice ``limit`` rows, chosen by top-k over the
    whole corpus; what is fused after that is bounded by ``limit``.  If
    vectors are wanted but can't be had, the other channels answer and
    ``diagnostic`` says why.
    """
    config = config or Config()
    limit = limit or config.default_limit
    mode, wanted = wants_vectors(config, mode, semantic)
    names, prefixes = query_entities(query), query_prefixes(query)
    matched = _matched(g, config, names)
    chunk = g.chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_id", "content")
    channels: list[DataFrame] = []

    def channel(df: DataFrame, name: str, order: int, by: list[Column], reason: Column) -> None:
        ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # bounded by limit or the query's names
        channels.append(ranked.select("document_id", "section_id", "content", "base", "rank", F.lit(name).alias("channel"), F.lit(order).alias("order"), reason.alias("reason"), _semantic(ranked)))

    def _semantic(df: DataFrame) -> Column:
        return (F.round("similarity", 4) if "similarity" in df.columns else F.lit(None).cast("double")).alias("similarity")

    if matched:
        channel(_definitions(g, matched), "definition", 0, [F.col("place")], F.lit("definition of an entity that the query names"))
    if prefixes:
        stored = g.extra.get("postings")  # an index that is stored; else the chunks are read
        matches = fts.bm25(g.chunks, "id", "content", prefixes, indexed=True) if stored is None else fts.bm25_postings(stored, g.extra["text_totals"], prefixes)
        scored = matches.orderBy(F.desc("score"), "id").limit(2 * limit)
        hits = chunk.join(F.broadcast(scored), F.col("chunk_id") == F.col("id")).withColumn("base", 100 + F.col("score"))  # 2 * limit rows
        channel(hits, "fts", 1, [F.desc("score"), F.col("chunk_id")], F.lit("full-text match"))
    diagnostic = None
    if wanted:
        try:
            v = query_vector(g, config, query)
            near = g.chunk_vectors.where((F.col("provider") == config.provider) & (F.col("model") == config.embedding_model))
            near = near.select("chunk_id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in v])).alias("similarity")).where("similarity > 0").orderBy(F.desc("similarity"), "chunk_id").limit(2 * limit)
            hits = chunk.join(F.broadcast(near), "chunk_id").withColumn("base", 80 + 50 * F.col("similarity"))  # 2 * limit rows
            source = "local" if config.provider == "local-hash" else config.provider
            channel(hits, "semantic", 2, [F.desc("similarity"), F.col("chunk_id")], F.concat(F.lit(f"{source} vector match ("), _fixed(F.col("similarity"), 3), F.lit(")")))
        except EmbeddingError as e:
            diagnostic = {"provider": config.provider, "code": e.code, "message": str(e)}
    results = _fused(g, config, channels, matched, limit)
    return SearchRun(results, query, limit, mode, names, matched, prefixes, wanted, config.provider if wanted and not diagnostic else None, diagnostic)


_ENTITY = "array<struct<id: string, name: string, normalized_name: string, kind: string, documents: bigint>>"


def _fused(g: GraphTables, config: Config, channels: list[DataFrame], matched: list[dict], limit: int) -> DataFrame:
    spark = g.documents.sparkSession
    if not channels:
        empty = "document_id string, section_id string, content string, base double, rank int, channel string, `order` int, reason string, similarity double"
        channels = [spark.createDataFrame([], empty)]
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    unique = list({m["id"]: m for m in matched}.values())
    fields = ("id", "name", "normalized_name", "kind", "documents")
    known = F.array(*[F.struct(*[F.lit(m[f]).alias(f) for f in fields]) for m in unique]).cast(_ENTITY) if unique else F.array().cast(_ENTITY)
    low = F.lower("content")
    inside = F.filter(known, lambda e: low.contains(F.lower(e["name"])) | low.contains(e["normalized_name"]))
    rows = F.broadcast(materialize(rows))  # 2 * limit rows a channel, which are used twice
    rows = rows.withColumn("entities", inside).join(g.documents.select(F.col("id").alias("document_id"), "path", "title", "type", "status", "trust_tier"), "document_id")
    common = F.filter("entities", lambda e: e["documents"] > config.high_frequency_entity_threshold)
    ranked_down = (F.col("channel") != "definition") & (F.size(common) > 0)
    details = F.array_join(F.transform(common, lambda e: F.concat(e["name"], F.lit(" in "), e["documents"].cast("string"), F.lit(" documents"))), ", ")
    boosts = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.lower(F.trim(c))], F.lit(0.0))
    base = F.col("base") + boosts(TRUST, F.col("trust_tier")) + boosts(STATUS, F.col("status")) + F.when(ranked_down, -F.least(F.lit(60), 20 * F.size(common))).otherwise(0)
    reason = F.when(ranked_down, F.concat("reason", F.lit("; ranked down for common entities ("), details, F.lit(")"))).otherwise(F.col("reason"))
    rows = rows.withColumn("key", F.coalesce("section_id", "document_id")).withColumn("base", base).withColumn("reason", reason)
    rows = rows.join(fuse(rows), "key").withColumn("score", F.round(F.col("base") + F.col("boost"), 4)).withColumn("seq", F.struct("order", "rank"))
    reasons = F.array_append(F.split("reason", "; "), F.concat(F.lit("fused ranks ("), F.col("how"), F.lit(")")))
    ordered = lambda c: F.sort_array(F.collect_list(F.struct("seq", c.alias("v"))))
    first = F.min_by(F.struct("document_id", "section_id", "path", "title", "type", "status", "trust_tier", "content"), F.struct((-F.col("score")).alias("s"), "seq"))
    merged = rows.groupBy("key").agg(
        first.alias("d"), F.max("score").alias("score"), F.min("seq").alias("seq"), F.array_join(F.array_distinct(F.flatten(F.transform(ordered(reasons), lambda x: x["v"]))), "; ").alias("reason"),
        F.array_distinct(F.flatten(F.transform(ordered(F.col("entities")), lambda x: x["v"]))).alias("entities"), F.max("similarity").alias("similarity"),
    )
    sections = g.sections.select(F.col("id").alias("key"), "anchor", "heading", "start_line", "end_line")
    best = materialize(merged.orderBy(F.desc("score"), "seq").limit(limit))
    out = best.join(sections.join(F.broadcast(best.select("key")), "key", "left_semi"), "key", "left")  # at most limit rows
    position = F.row_number().over(Window.orderBy(F.desc("score"), "seq"))  # at most limit rows
    return out.select(
        position.alias("rank"), F.col("key").alias("node_id"), "d.document_id", "d.section_id", "d.path", "d.title", "d.type", "d.status", "d.trust_tier", "anchor", "heading", "start_line", "end_line",
        "score", "reason", "d.content", "entities", "similarity",
    ).orderBy("rank")


def explain(run: SearchRun) -> dict:
    """How the results came about, without their rows."""
    return {f.name: getattr(run, f.name) for f in fields(run) if f.name != "results"}


def agent_limit(query: str, documents: int, base: int = 8) -> tuple[int, str]:
    """(how many results an agent gets, why): more for long questions and large corpora, from 4 to 24."""
    half, n, why = -(-base // 2), base, ["the default of the settings"]
    if len(query.split()) > 6 or len(query) > 80:
        n, why = n + half, [*why, "a long question"]
    if documents >= 1000:
        n, why = n + base, [*why, "a large index"]
    elif documents >= 100:
        n, why = n + half, [*why, "an index of middle size"]
    return max(4, min(24, n)), "; ".join(why)


def agent_context(query: str, documents: int, config: Config, known_files: list[str], max_chars: int | None) -> dict:
    """search_limit, max_depth, max_chars and why, for an agent's context."""
    limit, why = agent_limit(query, documents, config.default_limit)
    deep = bool(known_files) or len(query.split()) > 6 or documents >= 100
    chars = max_chars or (config.max_context_chars if deep else min(config.max_context_chars, 16_000))
    return {"search_limit": limit, "max_depth": min(4, config.max_depth + deep), "max_chars": chars, "why": f"{why}; {'the budget asked for' if max_chars else 'a budget by the question'}"}
