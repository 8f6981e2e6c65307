"""One report about a project: counts, health, evaluation, bundle, changes, paired runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Project
from .operators import evaluate, export
from .operators.build import now
from .operators.diff import source_hash
from .sources.store import counts


def warning_counts(warnings: DataFrame, top: int = 5) -> tuple[dict[str, int], list[dict]]:
    """(number by code, the most frequent codes; ties by code)."""
    by = warnings.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    rows = [r.asDict() for r in by.orderBy(F.desc("count"), "code").collect()]  # one row a code
    return {r["code"]: r["count"] for r in sorted(rows, key=lambda r: r["code"])}, rows[:top]


def trend(previous: str | None) -> dict:
    """Whether a former report was given, and is there."""
    if not previous:
        return {"state": "first_run"}
    return {"state": "previous_report_loaded" if os.path.isfile(previous) else "previous_report_missing", "previous": os.path.abspath(previous)}


def project_report(project: Project, cases: list[evaluate.Case] | None = None, bundle: str | None = None, base: str | None = None, runs: DataFrame | None = None, previous: str | None = None) -> dict:
    """What is known of a project; without an index only the bundle and the runs are judged."""
    out: dict = {"root": project.root, "generated_at": now(), "indexed": project.store.current() is not None, "trend": trend(previous)}
    if out["indexed"]:
        g = project.graph
        by_code, top = warning_counts(project.doctor().warnings)
        out |= {"counts": counts(g), "source_hash": source_hash(g.documents, project.config), "doctor": {"counts": by_code, "top": top}}
        if cases is not None:
            out["evaluation"] = evaluate.evaluate_retrieval(cases, lambda q: project.context(q), project.trace)[1]
        if base:
            out["diff"] = {"base": base, "summary": project.diff(base).summary()}
    if bundle:
        errors, fresh = export.verify_bundle(project.spark, bundle, project.graph if out["indexed"] else None, project.config)
        out["bundle"] = {"errors": [f"{e.code}: {e.message}" for e in errors], "fresh": fresh}
    if runs is not None:
        good, passed_over = evaluate.paired_runs(evaluate.run_metrics(runs))
        out["runs"] = {"pairs": good.count(), "passed_over": passed_over.count(), "total": evaluate.total_difference(good).first().asDict()}
    return out
