"""Command line: ``python -m quillgraph COMMAND``; text for people, or JSON with ``--json``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from . import render
from .api import MAX_KNOWN_FILES, Project, init_project
from .operators import evaluate, export
from .operators.health import SEVERITY, gate
from .operators.related import Options
from .operators.search import explain
from .report import project_report
from .session import local_session
from .sources import bounded, git

MODES = ("auto", "keyword", "semantic")


def positive(text: str) -> int:
    if not text.isdigit() or not 1 <= int(text) <= 1_000_000:
        raise argparse.ArgumentTypeError("a whole number from 1 to 1000000 is needed")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true", help="JSON instead of text")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> argparse.ArgumentParser:
        s = c.add_parser(name)
        for names, options in args:
            s.add_argument(*names, **options)
        return s

    flag = lambda name: ((name,), {"action": "store_true"})
    text = lambda name: ((name,), {})
    number = lambda name, default=None: ((name,), {"type": positive, "default": default})
    one_of = lambda name, values, default=None: ((name,), {"choices": values, "default": default})
    add("usage")
    add("init")
    add("index", flag("--full"))
    add("status", flag("--freshness"), flag("--storage"))
    add("search", text("query"), one_of("--mode", MODES, "auto"), number("--limit"), flag("--explain"))
    add("context", text("query"), one_of("--mode", MODES, "auto"), number("--limit"), number("--max-chars"), number("--max-depth"), one_of("--strategy", ("round-robin", "mmr"), "round-robin"), (("--known-file",), {"action": "append", "default": []}))
    add("query", text("source"))
    add("node", text("query"))
    add("trace", text("start"), text("end"), number("--depth", 6))
    add("mermaid", text("start"), text("end"), number("--depth", 6))
    add("doctor", flag("--changed"), text("--since"), flag("--strict"), one_of("--fail-on", ("error", "warn", "info")))
    add("eval", (("cases",), {"help": "a JSON list of cases"}))
    add("semantic")
    add("derive", flag("--dry-run"), (("--threshold",), {"type": float, "default": 0.86}), number("--neighbours", 3), number("--evidence", 2))
    add("diff", text("base"))
    add("report", text("--base"), text("--bundle"), text("--cases"), text("--runs"), text("--previous"), text("--out"))
    add("export", (("what",), {"choices": ("graph", "docs-index", "markdown-index", "source-bridge")}), (("--out",), {"help": "graph: a folder to which nodes and edges are written as JSON lines, for graphs of any size"}), (("--artifact",), {"help": "source-bridge: a JSON list of path and symbols"}))
    add("import", (("path",), {"help": "a graph written by export graph, to be verified"}))
    add("bundle", (("action",), {"choices": ("create", "verify")}), text("folder"))
    add("serve")
    add("watch", (("--interval",), {"default": "2 seconds"}), text("--checkpoint"))
    return p


def cases(path: str) -> list[evaluate.Case]:
    """Cases of an evaluation from a JSON list."""
    value = bounded.read_json(path)
    if not isinstance(value, list) or not all(isinstance(x, dict) and isinstance(x.get("id"), str) and isinstance(x.get("query"), str) for x in value):
        raise ValueError("a list of cases with an id and a query was expected")
    sections = lambda x: tuple((s["path"], s["heading"]) for s in x.get("expectedSections", []))
    trace = lambda t: (t["from"], t["to"], t.get("depth", 6)) if t else None
    return [evaluate.Case(x["id"], x["query"], tuple(x.get("expectedDocuments", [])), sections(x), tuple(x.get("expectedEntities", [])), tuple(x.get("expectedEdges", [])), tuple(x.get("expectedSourceRefs", [])), trace(x.get("trace"))) for x in value]


def artifact(spark, path: str):
    """Another tool's files: path and symbols."""
    rows = bounded.read_json(path)
    rows = rows.get("files") if isinstance(rows, dict) else rows
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("a list of objects with a path was expected")
    schema = "path string, symbols array<struct<name: string, kind: string>>"
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").selectExpr(f"from_json(value, '{schema}') AS r").select("r.*") if rows else spark.createDataFrame([], schema)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, spark)
    except (ValueError, OSError) as e:
        print(f"quillgraph: {e}", file=sys.stderr)
        return 2


def run(a: argparse.Namespace, spark=None) -> int:
    def show(value: object, text: str) -> None:
        plain = lambda v: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else str(v)
        print(json.dumps(value, default=plain, indent=2, ensure_ascii=False) if a.json else text)

    if a.command == "usage":
        show({"usage": render.USAGE.splitlines()}, render.USAGE)
        return 0
    if a.command == "init":
        written = init_project(a.root)
        show({"written": written}, "The settings were written." if written else "There are settings already.")
        return 0
    if a.command == "context" and len(a.known_file) > MAX_KNOWN_FILES:
        raise ValueError(f"at most {MAX_KNOWN_FILES} known files")
    project = Project(spark or local_session(), a.root)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    code = 0
    match a.command:
        case "index":
            done = project.index(a.full)
            show(done, render.pairs(done))
        case "status":
            s = project.status()
            if s["indexed"]:
                s |= ({"freshness": rows(project.freshness().limit(20))} if a.freshness else {}) | ({"storage": project.storage()} if a.storage else {})
            show(s, render.status(s))
        case "search":
            found = project.search(a.query, a.limit, a.mode)
            hits, about = rows(found.results), explain(found)
            show({"results": hits, "explanation": about} if a.explain else hits, (render.explanation(about) + "\n\n" if a.explain else "") + render.search(hits))
        case "context":
            found = project.context(a.query, max_chars=a.max_chars, max_depth=a.max_depth, search_limit=a.limit, strategy=a.strategy, known_files=a.known_file, mode=a.mode)
            show(found, render.context(found))
        case "query":
            every, top = project.query(a.source)
            total, hits = every.count(), rows(top)
            show({"total": total, "documents": hits}, render.documents(total, hits))
        case "node":
            found, edges = project.node(a.query)
            node, others, near = found.node and found.node.asDict(), [c.asDict() for c in found.candidates], rows(edges) if edges is not None else []
            show({"status": found.status, "node": node, "candidates": others, "edges": near}, render.node(found.status, a.query, node, others, near))
            code = int(found.status != "found")
        case "trace":
            t = project.trace(a.start, a.end, a.depth)
            show(t, render.trace(t))
        case "mermaid":
            print(project.mermaid(a.start, a.end, a.depth))
        case "doctor":
            report = project.doctor(git.scope(a.root, a.since) if a.since or a.changed else None)
            codes, told = {k: n for k, n in sorted(report.summary().items()) if k in SEVERITY}, rows(report.warnings)
            show({"codes": codes, "warnings": told}, render.doctor(codes, told))
            code = gate(report, a.fail_on, a.strict)
        case "eval":
            results, summary = evaluate.evaluate_retrieval(cases(a.cases), lambda q: project.context(q), project.trace)
            show({"results": results, "summary": summary}, render.evaluation(results, summary))
            code = int(summary["passed"] < summary["cases"])
        case "semantic":
            state = project.semantic_status()
            show({"state": state}, f"Vectors: {state}")
        case "derive":
            pairs = rows(project.derive(Options(a.threshold, a.neighbours, a.evidence), a.dry_run).pairs)
            show(pairs, render.related(pairs))
        case "diff":
            found = project.diff(a.base)
            d = {"summary": found.summary(), "documents": rows(found.documents), "source_refs": rows(found.source_refs), "warnings": rows(found.warnings)}
            show(d, render.diff(d))
        case "report":
            r = project_report(project, cases(a.cases) if a.cases else None, a.bundle, a.base, bounded.read_runs(project.spark, a.runs) if a.runs else None, a.previous)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    json.dump(r, f, indent=2, ensure_ascii=False, default=str)
            show(r, render.report(r))
        case "export":
            if a.what == "graph" and a.out:
                export.write_graph_json(project.graph, a.out)
            elif a.what == "graph":
                print(json.dumps(project.graph_json(), indent=2, ensure_ascii=False))
            elif a.what == "docs-index":
                print(json.dumps(rows(export.docs_index(project.graph)), indent=2, ensure_ascii=False))
            elif a.what == "markdown-index":
                print(export.render_markdown_index(project.graph, export.source_hash(project.graph.documents, project.config)))
            else:
                if not a.artifact:
                    raise ValueError("--artifact is needed")
                hit, missing = export.source_bridge(project.graph, artifact(project.spark, a.artifact))
                print(json.dumps({"matched": rows(hit), "missing": [r["source_ref"] for r in missing.collect()]}, indent=2, ensure_ascii=False))
        case "import":
            errors, notes = export.verify_graph_json(export.read_graph_json(a.path))
            show({"errors": errors, "notes": notes}, "\n".join([render.problems("graph", errors), *notes]))
            code = int(bool(errors))
        case "bundle":
            if a.action == "create":
                made = export.create_bundle(project.graph, os.path.abspath(a.folder), project.config)
                show(made, f"The bundle was written to {a.folder}: {made['bundleHash']}")
            else:
                errors, fresh = export.verify_bundle(project.spark, os.path.abspath(a.folder), project.graph if project.store.current() else None, project.config)
                show({"errors": errors, "fresh": fresh}, render.problems("bundle", errors, fresh))
                code = int(bool(errors))
        case "serve":
            from .server import Server

            Server(project).serve()
        case "watch":
            from .streaming.watch import Watcher

            w = Watcher(project.spark, a.root, project.store, project.config)
            try:
                w.start(a.checkpoint or f"{project.store.root}/watch", a.interval).awaitTermination()
            except KeyboardInterrupt:
                w.stop()
            code = int(w.health.state == "failed")
    return code


if __name__ == "__main__":
    sys.exit(main())
