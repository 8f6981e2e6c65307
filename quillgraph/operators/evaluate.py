"""Evaluation: retrieval and extraction metrics, paired runs of agents."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GraphTables
from .context import Context
from .relate import jaccard_pairs

CASE_SCHEMA = (
    "id string, query string, expectedDocuments array<string>, expectedSections array<struct<path: string, heading: string>>, expectedEntities array<string>, "
    "expectedEdges array<string>, expectedSourceRefs array<string>, trace struct<from: string, to: string, depth: int, edgeKinds: array<string>>"
)


@dataclass(frozen=True)
class Case:
    id: str
    query: str
    documents: tuple[str, ...] = ()
    sections: tuple[tuple[str, str], ...] = ()
    entities: tuple[str, ...] = ()
    edges: tuple[str, ...] = ()
    source_refs: tuple[str, ...] = ()
    trace: tuple[str, str, int] | None = None


@dataclass
class CaseResult:
    id: str
    passed: bool
    recall: float
    section_recall: float
    source_recall: float
    precision: float
    diversity: float
    trace_found: bool | None = None
    missing: list[str] = field(default_factory=list)


def _share(found: Iterable, wanted: Iterable) -> float:
    wanted = set(wanted)
    return len(wanted & set(found)) / len(wanted) if wanted else 1.0


def evaluate_retrieval(cases: list[Case], context_of: Callable[[str], Context], trace_of: Callable[[str, str, int], dict] | None = None) -> tuple[list[CaseResult], dict[str, float]]:
    """A case passes when all its documents, sections and sources are in the context and its path is found."""
    out = []
    for case in cases:
        c = context_of(case.query)
        paths = list(dict.fromkeys(i.path for i in c.items))
        sections = {(i.path, i.heading) for i in c.items}
        sources = {r["path"] for i in c.items for r in i.source_refs}
        traced = None
        if case.trace and trace_of:
            t = trace_of(*case.trace)
            traced = t["found"]
        r, s, f = _share(paths, case.documents), _share(sections, case.sections), _share(sources, case.source_refs)
        precision = len(set(paths) & set(case.documents)) / len(paths) if paths else 0.0
        missing = [d for d in case.documents if d not in paths] + [f"{p}#{h}" for p, h in case.sections if (p, h) not in sections] + [x for x in case.source_refs if x not in sources]
        out.append(CaseResult(case.id, r == s == f == 1.0 and traced is not False, r, s, f, precision, len(paths) / len(c.items) if c.items else 0.0, traced, missing))
    mean = lambda name: round(sum(getattr(x, name) for x in out) / len(out), 4) if out else 0.0
    return out, {"cases": len(out), "passed": sum(x.passed for x in out)} | {n: mean(n) for n in ("recall", "section_recall", "source_recall", "precision", "diversity")}


def set_metrics(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, expected, actual, hits of two sets of rows; 1 where there is nothing to find or nothing found wrong."""
    e, a = expected.select(*keys).distinct().withColumn("e", F.lit(1)), actual.select(*keys).distinct().withColumn("a", F.lit(1))
    n = e.join(a, keys, "full_outer").agg(F.sum(F.coalesce("e", F.lit(0))).alias("expected"), F.sum(F.coalesce("a", F.lit(0))).alias("actual"), F.sum(F.coalesce(F.col("e") * F.col("a"), F.lit(0))).alias("hits"))
    share = lambda whole: F.when(F.col(whole) > 0, F.round(F.col("hits") / F.col(whole), 4)).otherwise(F.lit(1.0))
    return n.na.fill(0).select(share("actual").alias("precision"), share("expected").alias("recall"), "expected", "actual", "hits")


def recall_at(rankings: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query, recall: ``rankings`` (query, id, rank), ``expected`` (query, id)."""
    top = rankings.where(F.col("rank") <= k).select("query", "id").distinct().withColumn("hit", F.lit(1))
    return expected.distinct().join(top, ["query", "id"], "left").groupBy("query").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def redundancy(similarities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """avg, max and the number of near duplicates among pairs (similarity)."""
    s = F.col("similarity")
    return similarities.agg(F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias("average"), F.round(F.coalesce(F.max(s), F.lit(0.0)), 4).alias("maximum"), F.coalesce(F.sum((s >= threshold).cast("int")), F.lit(0)).alias("near_duplicates"))


def packing_redundancy(items: DataFrame, key: str, tokens: str, threshold: float = 0.8) -> DataFrame:
    """``redundancy`` among the items of one context, by the Jaccard index of their tokens."""
    return redundancy(jaccard_pairs(items, key, tokens).withColumnRenamed("jaccard", "similarity"), threshold)


# ----------------------------------------------------------- runs of an agent
def _sum(items: str, name: str) -> Column:
    return F.aggregate(F.coalesce(items, F.array()), F.lit(0.0), lambda s, x: s + F.coalesce(x[name], F.lit(0.0)))


def run_metrics(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A row of measures for each run; with ``expected`` (questionId, paths) citations are judged by it."""
    cited = F.coalesce("finalCitations", F.array().cast("array<struct<path: string, line: int, correct: boolean>>"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\./", "")
    if expected is None:
        rows = runs.withColumn("paths", F.lit(None).cast("array<string>"))
    else:
        rows = runs.join(expected.select("questionId", F.transform("paths", clean).alias("paths")), "questionId", "left")
    ok = lambda x: F.coalesce(F.array_contains("paths", clean(x["path"])), x["correct"])
    good, bad, open_ = (F.size(F.filter(cited, f)) for f in (lambda x: F.coalesce(ok(x), F.lit(False)), lambda x: F.coalesce(~ok(x), F.lit(False)), lambda x: ok(x).isNull()))
    n = lambda c: F.size(F.coalesce(c, F.array()))
    return rows.select(
        "id", "questionId", F.trim("question").alias("question"), "mode",
        n("toolCalls").alias("tool_calls"), _sum("toolCalls", "outputChars").alias("tool_chars"), n("directFileReads").alias("file_reads"), _sum("directFileReads", "chars").alias("file_chars"),
        n("textSearches").alias("text_searches"), _sum("textSearches", "resultCount").alias("text_results"), n("graphCalls").alias("graph_calls"), _sum("graphCalls", "chars").alias("graph_chars"),
        _sum("graphCalls", "resultCount").alias("graph_results"), "tokenEstimate", "latencyMs", F.col("rawFileFallback").cast("int").alias("fallback"),
        good.alias("correct"), bad.alias("incorrect"), open_.alias("unknown"), F.when(good + bad > 0, F.round(good / (good + bad), 4)).alias("citation_rate"),
    )


MEASURES = ("tool_calls", "tool_chars", "file_reads", "file_chars", "text_searches", "text_results", "graph_calls", "graph_chars", "graph_results", "tokenEstimate", "latencyMs", "fallback", "unknown", "citation_rate")


def paired_runs(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences with minus without, by question; questions passed over and why), by one conditional aggregation."""
    w, o = F.col("mode") == "with_graph", F.col("mode") == "without_graph"
    count = lambda c: F.sum(c.cast("int"))
    pick = lambda c, m: F.max(F.when(c, F.col(m)))
    g = metrics.groupBy("questionId").agg(
        F.countDistinct("question").alias("texts"), count(w).alias("n_with"), count(o).alias("n_without"), F.max(F.when(w, F.col("question"))).alias("question"), F.sort_array(F.collect_list("id")).alias("records"),
        *[F.round(pick(w, m) - pick(o, m), 4).alias(m) for m in MEASURES],
    )
    bad = F.when(F.col("texts") > 1, "question_text_mismatch").when((F.col("n_with") != 1) | (F.col("n_without") != 1), F.concat(F.lit("one run of each mode is needed, not "), "n_with", F.lit(" with and "), "n_without", F.lit(" without")))
    marked = g.withColumn("reason", bad)
    return marked.where("reason IS NULL").select("questionId", "question", *MEASURES), marked.where("reason IS NOT NULL").select("questionId", "reason", "records")


def total_difference(pairs: DataFrame) -> DataFrame:
    """Sums over the pairs; the citation rate is an average of those known."""
    sums = [F.sum(m).alias(m) for m in MEASURES if m != "citation_rate"]
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), *sums, F.round(F.avg("citation_rate"), 4).alias("citation_rate"))


def semantic_status(g: GraphTables, provider: str, model: str, dimensions: int, enabled: bool, known: Iterable[str]) -> str:
    """disabled, not_indexed, unsupported_provider, needs_reindex or ready."""
    if not enabled:
        return "disabled"
    if provider not in known:
        return "unsupported_provider"
    chunks = g.chunks.count()
    if not chunks:
        return "not_indexed"
    own = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)
    n = g.chunk_vectors.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum(own.cast("int")), F.lit(0)).alias("own")).first()
    return "ready" if n["own"] == chunks == n["all"] else "needs_reindex"
