"""Plain text for people: what the command line and the tools print."""

from __future__ import annotations

from collections.abc import Iterable

MAX_BLOCK = 1_200


def block(text: str, most: int = MAX_BLOCK) -> str:
    text = text.strip()
    return text if len(text) <= most else text[:most].rstrip() + "\n..."


def place(path: str, anchor: str | None = None, line: int | None = None) -> str:
    return path + (f"#{anchor}" if anchor else "") + (f":{line}" if line else "")


def pairs(items: dict) -> str:
    return ", ".join(f"{k} {v}" for k, v in items.items())


def status(s: dict) -> str:
    if not s.get("indexed"):
        return "Nothing is indexed here. Run the index command first."
    tables = {k: v for k, v in s.items() if k in ("documents", "sections", "entities", "source_refs", "edges", "chunks", "chunk_vectors")}
    lines = [f"Indexed at {s['indexed_at']}, {s['bytes']} bytes", pairs(tables)]
    if "freshness" in s:
        lines.append(freshness(s["freshness"]))
    if "storage" in s:
        lines.append(storage(s["storage"]))
    return "\n".join(lines)


def freshness(issues: list[dict]) -> str:
    return "The index is up to date." if not issues else "\n".join([f"{len(issues)} file(s) changed since:", *[f"- {i['path']} ({i['reason']})" for i in issues]])


def storage(s: dict) -> str:
    lines = ["Largest path groups:", *[f"- {g['path_group']}: {g['documents']} documents, {g['chunks']} chunks, {g['content_bytes']} bytes" for g in s["path_groups"]]]
    lines += ["Edges by kind:", *[f"- {e['kind']}: {e['edges']}" for e in s["edge_kinds"]], "Nodes with most edges:", *[f"- {n['label']} ({n['kind']}): {n['degree']}" for n in s["high_degree"]]]
    return "\n".join(lines + ["Vectors:", *[f"- {v['provider']}/{v['model']}/{v['dimensions']}: {v['vectors']}, invalid {v['invalid']}" for v in s["vectors"]]])


def search(rows: list[dict]) -> str:
    if not rows:
        return "Nothing was found."
    out = []
    for r in rows:
        names = ", ".join(f"{e['name']} ({e['kind']})" for e in r["entities"])
        out.append("\n".join([f"{r['rank']}. {place(r['path'], r['anchor'], r['start_line'])}", f"Reason: {r['reason']}", *([f"Entities: {names}"] if names else []), block(r["content"])]))
    return "\n\n".join(out)


def explanation(e: dict) -> str:
    lines = [f"Query: {e['query']} (mode {e['mode']}, at most {e['limit']})", f"Names: {', '.join(e['candidates']) or 'none'}"]
    lines += [f"- {m['name']} ({m['kind']}), in {m['documents']} documents" for m in e["matched"]]
    lines.append(f"Full text: {', '.join(e['prefixes']) or 'none'}")
    if e["semantic_requested"]:
        lines.append(f"Vectors: {e['semantic_provider'] or 'not used'}" + (f" ({e['diagnostic']['code']}: {e['diagnostic']['message']})" if e["diagnostic"] else ""))
    return "\n".join(lines)


def context(c) -> str:
    if not c.items:
        return "There is no context for this."
    head = [f"Context for: {c.query}", f"Budget: {c.used_chars} of {c.max_chars} characters, {c.strategy}"]
    if c.known_files:
        head.append(f"Known files: {', '.join(c.known_files)}")
    if c.suggestions:
        head += ["Next queries:", *[f"- {q}" for q in c.suggestions]]
    out = ["\n".join(head)]
    for i, item in enumerate(c.items, 1):
        refs = ", ".join(f"{r['path']} ({r['kind']}/{r['provenance']})" for r in item.source_refs)
        more = [("Entities", ", ".join(item.entities)), ("Source files", refs), ("Risks", "; ".join(item.risks))]
        lines = [f"## {i}. {place(item.path, None, item.lines and item.lines[0])}", f"Reason: {item.reason}", *[f"{k}: {v}" for k, v in more if v], f"# {item.heading or item.title}", item.content]
        out.append("\n".join(lines))
    return "\n\n".join(out)


def documents(total: int, rows: list[dict]) -> str:
    return "\n".join([f"{total} document(s)", *[f"- {r['path']} [{r['type']}, {r['status']}] {r['title']}" for r in rows]])


def node(status_: str, query: str, found: dict | None, candidates: list[dict], edges: list[dict]) -> str:
    if status_ == "ambiguous":
        return "\n".join([f"{query} may be one of:", *[f"- {c['id']} {c['label']} ({place(c['path'] or '', c.get('anchor'), c['line'])})" for c in candidates]])
    if found is None:
        return f"No node is called {query}."
    lines = [f"{found['label']} ({found['kind']})", f"Id: {found['id']}", *([f"Place: {place(found['path'], found.get('anchor'), found['line'])}"] if found["path"] else [])]
    arrow = lambda e: "-->" if e["from_id"] == found["id"] else "<--"
    return "\n".join(lines + [f"{arrow(e)} {e['kind']} {e['label'] or e['other']} ({e['provenance']}, {e['confidence']:g})" for e in edges])


def trace(t: dict) -> str:
    if not t["found"]:
        return t["message"]
    if not t["steps"]:
        return f"{t['from']} is {t['to']}."
    return "\n".join([f"From {t['from']} to {t['to']}, {len(t['steps'])} step(s)", *[f"{s['from_label']} {'-->' if s['direction'] == 'forward' else '<--'} [{s['kind']}/{s['provenance']}/{s['confidence']:g}] {s['to_label']}" for s in t["steps"]]])


def doctor(codes: dict, warnings: list[dict]) -> str:
    if not warnings:
        return "All is well."
    lines = [", ".join(f"{k}={n}" for k, n in codes.items())]
    return "\n".join(lines + [f"[{w['severity']}] {w['code']} {place(w['path'] or w['label'] or '', None, w['line'])}: {w['message']} {w['remediation']}" for w in warnings])


def related(pairs_: list[dict]) -> str:
    return "\n".join([f"{len(pairs_)} pair(s)", *[f"- {p['a_path']} <-> {p['b_path']} ({p['confidence']:.4f}, {len(p['evidence'])} pairs of chunks)" for p in pairs_]])


def diff(d: dict) -> str:
    lines = [pairs(d["summary"])]
    lines += [f"- {r['change']} {(r['previous_path'] + ' -> ') if r['previous_path'] else ''}{r['path']}" for r in d["documents"]]
    lines += [f"- source file on one side only: {r['path']}" for r in d["source_refs"]]
    return "\n".join(lines + [f"- {w['code']} {w['delta']:+d}" for w in d["warnings"]])


def evaluation(results: Iterable, summary: dict) -> str:
    lines = [f"{summary['passed']} of {summary['cases']} cases passed", pairs({k: v for k, v in summary.items() if k not in ("cases", "passed")})]
    return "\n".join(lines + [f"- {'ok' if r.passed else 'failed'} {r.id}: recall {r.recall:.2f}, precision {r.precision:.2f}" + (f", missing {', '.join(r.missing)}" if r.missing else "") for r in results])


def problems(what: str, errors: list, fresh: bool | None = None) -> str:
    lines = [f"The {what} is {'sound' if not errors else 'not sound'}." + ("" if fresh is None else " It is as fresh as the index." if fresh else " The index has changed since.")]
    return "\n".join(lines + [f"- {e.code}: {e.message}" + (f" ({e.at})" if e.at else "") for e in errors])


def report(r: dict) -> str:
    lines = [f"Report on {r['root']}, {r['generated_at']}", f"Indexed: {r['indexed']}"]
    if not r["indexed"]:
        lines.append("Index the project before trusting summaries of its health.")
    else:
        lines += [pairs(r["counts"]), f"Source hash: {r['source_hash']}", f"Warnings: {sum(r['doctor']['counts'].values())}", f"Most frequent: {', '.join(f'{w['code']}={w['count']}' for w in r['doctor']['top']) or 'none'}"]
    if "evaluation" in r:
        lines.append(f"Evaluation: {r['evaluation']['passed']} of {r['evaluation']['cases']} cases passed, recall {r['evaluation']['recall']}")
    if "bundle" in r:
        lines += [f"Bundle: {'sound' if not r['bundle']['errors'] else 'not sound'}", *[f"- {e}" for e in r["bundle"]["errors"]]]
    if "diff" in r:
        lines.append(f"Since {r['diff']['base']}: {pairs(r['diff']['summary'])}")
    if "runs" in r:
        lines.append(f"Paired runs: {r['runs']['pairs']}, passed over: {r['runs']['passed_over']}")
    return "\n".join(lines + [f"Trend: {r['trend']['state']}"])


USAGE = """Before a task:   status --freshness, then context "what the task is about"
To find a place: search "words or `Names`", then node ID
To connect two:  trace START END
To filter:       query 'type = adr AND status = active ORDER BY updated DESC'
After edits:     index, then doctor --changed --fail-on error
To compare:      diff REVISION, report --base REVISION"""
