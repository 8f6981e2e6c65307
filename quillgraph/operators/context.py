"""Context for a question: search results, their neighbourhood, packed into a budget.

The neighbourhood is fetched by joins, a hop at a time and with a bound for
each node; choosing among its few nodes is sequential by nature and happens
on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from ..model import Config, GraphTables
from .extract import content_risks
from .nodes import all_nodes, context_chunks, edges_of, resolve_node
from .search import search

MIN_NODES, SAME_DOCUMENT, MMR_LAMBDA, KNOWN_SCORE = 16, 0.8, 0.65, 10_000
STRATEGIES = ("round-robin", "mmr")
_WORD = regex.compile(r"[\p{L}\p{N}_]+")


@dataclass
class Step:
    from_id: str
    to_id: str
    kind: str
    provenance: str
    confidence: float
    forward: bool
    from_label: str = ""
    to_label: str = ""

    def __str__(self) -> str:
        edge = f"{self.kind}/{self.provenance}/{self.confidence:g}"
        return f"{self.from_label} --{edge}--> {self.to_label}" if self.forward else f"{self.from_label} <--{edge}-- {self.to_label}"


@dataclass
class Candidate:
    node_id: str
    document_id: str
    path: str
    title: str
    content: str
    score: float
    direct: bool
    reason: str
    status: str = "active"
    trust_tier: str = "authored"
    declared: bool = False
    section_id: str | None = None
    anchor: str | None = None
    heading: str | None = None
    lines: tuple[int, int] | None = None
    entities: list[str] = field(default_factory=list)
    edge_path: list[Step] = field(default_factory=list)
    chunk_id: str | None = None
    source_refs: list[dict] = field(default_factory=list)
    risks: list[str] = field(default_factory=list)


@dataclass
class Context:
    query: str
    max_chars: int
    used_chars: int
    strategy: str
    items: list[Candidate]
    similarity: str | None = None
    skipped_redundant: int = 0
    truncated: int = 0
    skipped: int = 0
    known_files: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)
    diagnostic: dict | None = None
    debug: dict = field(default_factory=dict)
    selections: list[dict] = field(default_factory=list)


def _from_chunk(row: Row, score: float, direct: bool, reason: str, path: list[Step] | None = None) -> Candidate:
    lines = (row["start_line"], row["end_line"]) if row["section_id"] and row["start_line"] is not None else None
    return Candidate(
        row["section_id"] or row["document_id"], row["document_id"], row["path"], row["title"], row["chunk_content"], score, direct, reason, row["status"], row["trust_tier"], bool(row["declared"]),
        row["section_id"], row["anchor"], row["heading"], lines, [], path or [],
    )


def upsert(held: dict[str, Candidate], c: Candidate) -> None:
    """A better score or a direct hit takes the place of what is held; the order of arrival matters."""
    old = held.get(c.node_id)
    if old is None or c.score > old.score or (c.direct and not old.direct):
        held[c.node_id] = c


def interleave(items: list[Candidate]) -> list[Candidate]:
    """Best first, documents in turns, direct hits before others."""
    out: list[Candidate] = []
    for direct in (True, False):
        by_path: dict[str, list[Candidate]] = {}
        for c in sorted((x for x in items if x.direct == direct), key=lambda x: -x.score):
            by_path.setdefault(c.path, []).append(c)
        turn = 0
        while any(len(v) > turn for v in by_path.values()):
            out += [v[turn] for v in by_path.values() if len(v) > turn]
            turn += 1
    return out


def expand(g: GraphTables, config: Config, held: dict[str, Candidate], seeds: list[tuple[str, float]], max_depth: int) -> dict:
    """Best-first over all but containment edges, within a budget of nodes."""
    budget = max(MIN_NODES, 2 * config.default_limit)
    left, visited = budget, {}
    queue: list[tuple[str, int, float, list[Step]]] = []
    stats = {"seeds": 0, "expanded_edges": 0, "skipped_visited": 0, "skipped_by_limit": 0, "skipped_by_depth": 0}
    for node, score in seeds:
        if node in visited:
            stats["skipped_visited"] += 1
            continue
        visited[node] = True
        stats["seeds"] += 1
        queue.append((node, 0, score, []))
    near: dict[str, list[Row]] = {}
    reached: list[tuple[str, float, list[Step]]] = []
    while queue:
        node, depth, score, path = queue.pop(0)
        if depth >= max_depth:
            stats["skipped_by_depth"] += 1
            continue
        if node not in near:
            ask = [node] + [q[0] for q in queue if q[0] not in near and q[1] < max_depth]
            bound = budget + len(visited) + len(ask)  # enough to find every neighbour that could still be taken
            for q in ask:
                near[q] = []
            for row in edges_of(g, ask, bound, "CONTAINS").orderBy("node", "rank").collect():  # bounded for each node
                near[row["node"]].append(row)
        for e in near[node]:
            to = e["other"]
            if to in visited:
                stats["skipped_visited"] += 1
            elif left <= 0:
                stats["skipped_by_limit"] += 1
            else:
                strength = e["weight"] * e["confidence"]
                step = Step(node, to, e["kind"], e["provenance"], e["confidence"], e["from_id"] == node)
                visited[to] = True
                left -= 1
                stats["expanded_edges"] += 1
                to_score = score + strength - 2 * (depth + 1)
                reached.append((to, to_score, path + [step]))
                queue.append((to, depth + 1, to_score, path + [step]))
        queue.sort(key=lambda q: -q[2])
    if reached:
        ids = sorted({x for _, _, p in reached for s in p for x in (s.from_id, s.to_id)})
        labels = {r["id"]: r["label"] for r in all_nodes(g).where(F.col("id").isin(ids)).orderBy(F.desc("order")).select("id", "label").collect()}  # bounded by the budget
        rows = {r["node_id"]: r for r in context_chunks(g, [n for n, _, _ in reached]).collect()}
        for node, score, path in reached:
            for s in path:
                s.from_label, s.to_label = labels.get(s.from_id, s.from_id), labels.get(s.to_id, s.to_id)
            if node in rows:
                upsert(held, _from_chunk(rows[node], score, False, "reached via " + " | ".join(map(str, path)), path))
    return stats | {"visited": len(visited)}


def _known_files(g: GraphTables, names: list[str]) -> list[Candidate]:
    out = []
    for i, name in enumerate(names):
        found = next((r for q in dict.fromkeys((name, name.replace("\\", "/").removeprefix("./"))) if (r := resolve_node(g, q)).status == "found"), None)
        if found is None:
            continue
        if found.node["kind"] != "source_ref":
            out += [_from_chunk(r, KNOWN_SCORE - i, True, f"known file {name}") for r in context_chunks(g, [found.node["id"]]).collect()]  # one row
            continue
        edges = edges_of(g, [found.node["id"]], 200).orderBy("rank").collect()  # a source file's own edges
        rows = {r["node_id"]: r for r in context_chunks(g, [e["other"] for e in edges]).collect()} if edges else {}
        out += [_from_chunk(rows[e["other"]], KNOWN_SCORE - i, True, f"known file {name} via {e['kind']}/{e['provenance']}") for e in edges if e["other"] in rows]
    return out


def _enrich(g: GraphTables, items: list[Candidate]) -> None:
    """Chunks, source files and risks of the candidates."""
    if not items:
        return
    chunks = {r["node_id"]: r["chunk_id"] for r in context_chunks(g, [c.node_id for c in items]).select("node_id", "chunk_id").collect()}  # the candidates
    ids = list({x for c in items for x in (c.node_id, c.document_id)})
    refs = edges_of(g, ids).where(F.col("kind").isin("IMPLEMENTS", "REFERENCES_SOURCE"))
    refs = refs.join(g.source_refs.select(F.col("id").alias("other"), F.col("path").alias("source")), "other").select("node", "source", "kind", "provenance", "confidence")
    by_node: dict[str, list[Row]] = {}
    for r in refs.collect():  # the candidates' source files
        by_node.setdefault(r["node"], []).append(r)
    texts = g.chunks.sparkSession.createDataFrame([(str(i), c.content) for i, c in enumerate(items)], "path string, body string")
    risky: dict[int, list[Row]] = {}
    for r in content_risks(texts).orderBy("id", "line").collect():  # the candidates' lines
        risky.setdefault(int(r["id"]), []).append(r)
    for i, c in enumerate(items):
        c.chunk_id = chunks.get(c.node_id)
        found = {(r["source"], r["kind"]): {"path": r["source"], "kind": r["kind"], "provenance": r["provenance"], "confidence": r["confidence"]} for n in dict.fromkeys((c.node_id, c.document_id)) for r in by_node.get(n, [])}
        c.source_refs = [found[k] for k in sorted(found)]
        if (status := c.status.strip().lower()) and status != "active":
            c.risks.append(f"document status: {c.status}")
        if c.trust_tier not in ("authored", "validated"):
            c.risks.append(f"trust tier: {c.trust_tier}")
        if c.trust_tier == "validated" and c.declared:
            c.risks.append("trust tier: validated (as its front matter declares)")
        c.risks += [f"content risk: {r['reason']} at line {(c.lines[0] - 1 if c.lines else 0) + r['line']}" for r in risky.get(i, [])[:3]]


def _clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def similarity(a: Candidate, b: Candidate, vectors: dict[str, list[float]], tokens: dict[str, set[str]]) -> tuple[float, str]:
    u, v = vectors.get(a.chunk_id or ""), vectors.get(b.chunk_id or "")
    if u is not None and v is not None and len(u) == len(v):
        size = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
        return _clamp(sum(x * y for x, y in zip(u, v)) / size if size else 0.0), "embedding-cosine"
    s, t = tokens[a.node_id], tokens[b.node_id]
    return (len(s & t) / len(s | t) if s or t else 0.0), "lexical-jaccard"


def mmr(items: list[Candidate], vectors: dict[str, list[float]], lam: float = MMR_LAMBDA) -> tuple[list[Candidate], list[dict], int, str]:
    """Maximal marginal relevance; near repetitions from a chosen document are passed over."""
    tokens = {c.node_id: set(_WORD.findall(c.content.lower())) for c in items}
    top = max([1.0, *(c.score for c in items)])
    rest, chosen, picks, skipped = list(enumerate(items)), [], [], 0
    worst = {i: (0.0, "none") for i, _ in rest}
    while rest:
        scored = [(lam * (rel := _clamp(max(0.0, c.score) / top)) - (1 - lam) * worst[i][0], rel, -i, c) for i, c in rest]
        value, rel, at, best = max(scored, key=lambda x: x[:3])
        rest = [(i, c) for i, c in rest if i != -at]
        penalty, source = worst[-at]
        if penalty >= SAME_DOCUMENT and any(c.path == best.path for c in chosen):
            skipped += 1
            continue
        chosen.append(best)
        picks.append({"node_id": best.node_id, "path": best.path, "relevance": round(rel, 4), "redundancy": round(penalty, 4), "score": round(value, 4), "source": source})
        for i, c in rest:
            s = similarity(c, best, vectors, tokens)
            if s[0] > worst[i][0]:
                worst[i] = s
    with_vector = sum((c.chunk_id or "") in vectors for c in items)
    kind = "embedding-cosine" if items and with_vector == len(items) else "hybrid" if with_vector > 1 else "lexical-jaccard"
    return chosen, picks, skipped, kind


def cut(text: str, room: int) -> str:
    if len(text) <= room:
        return text
    return text[:room] if room <= 3 else (text[: room - 3].rstrip() + "...")[:room]


def pack(items: list[Candidate], max_chars: int) -> tuple[list[Candidate], int, int, int]:
    """(packed, used, truncated, skipped): in order, the one that crosses the budget is cut."""
    out, used, truncated, skipped = [], 0, 0, 0
    for k, c in enumerate(items):
        room = max_chars - used
        if room <= 0:
            skipped += len(items) - k
            break
        text = cut(c.content, room)
        if not text:
            skipped += 1
            continue
        truncated += len(text) < len(c.content)
        used += len(text)
        out.append(replace(c, content=text))
    return out, used, truncated, skipped


def build_context(
    g: GraphTables,
    query: str,
    config: Config | None = None,
    max_chars: int | None = None,
    max_depth: int | None = None,
    search_limit: int | None = None,
    known_files: list[str] | None = None,
    strategy: str = "round-robin",
    mmr_lambda: float = MMR_LAMBDA,
    mode: str = "auto",
    semantic: bool | None = None,
) -> Context:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    config = config or Config()
    positive = lambda v, default: v if isinstance(v, int) and v > 0 else default
    run = search(g, query, config, positive(search_limit, 2 * config.default_limit), mode, semantic)
    found = run.results.collect()  # at most search_limit rows
    declared = {r["id"]: r["d"] for r in g.documents.where(F.col("id").isin(list({r["document_id"] for r in found}))).select("id", F.get_json_object("metadata_json", "$.declaredTrustTier").isNotNull().alias("d")).collect()} if found else {}
    held: dict[str, Candidate] = {}
    seeds: list[tuple[str, float]] = []
    for r in found:
        lines = (r["start_line"], r["end_line"]) if r["section_id"] else None
        upsert(held, Candidate(r["node_id"], r["document_id"], r["path"], r["title"], r["content"], r["score"], True, r["reason"], r["status"], r["trust_tier"], declared.get(r["document_id"], False), r["section_id"], r["anchor"], r["heading"], lines, [f"{e['name']} ({e['kind']})" for e in r["entities"]]))
        seeds += [(n, r["score"]) for n in dict.fromkeys([r["document_id"], *([r["section_id"]] if r["section_id"] else []), *(e["id"] for e in r["entities"])])]
    stats = expand(g, config, held, seeds, positive(max_depth, config.max_depth))
    items = interleave(list(held.values()))
    known = list(dict.fromkeys(f.replace("\\", "/").removeprefix("./").strip() for f in known_files or [] if f.strip()))
    if known:
        merged: dict[str, Candidate] = {}
        for c in [*items, *_known_files(g, known)]:
            upsert(merged, c)
        items = interleave(list(merged.values()))
    _enrich(g, items)
    picks, redundant, kind, order = [], 0, None, items
    if strategy == "mmr":
        profile = (F.col("provider") == config.provider) & (F.col("model") == config.embedding_model) & (F.col("dimensions") == config.dimensions)
        own = g.chunk_vectors.where(profile & F.col("chunk_id").isin([c.chunk_id for c in items if c.chunk_id] or [""])).collect()  # the candidates' vectors
        vectors = {r["chunk_id"]: list(r["vector"]) for r in own if len(r["vector"]) == config.dimensions}
        order, picks, redundant, kind = mmr(items, vectors, mmr_lambda if 0 <= mmr_lambda <= 1 else MMR_LAMBDA)
    budget = positive(max_chars, config.max_context_chars)
    packed, used, truncated, skipped = pack(order, budget)
    paths = list(dict.fromkeys(c.path for c in packed))
    entities = list(dict.fromkeys(e.rsplit(" (", 1)[0] for c in packed for e in c.entities))
    hints = [f'node "{paths[0]}"' if paths else "", f'trace "{known[0]}" "{paths[0]}"' if known and paths else "", f'search "{entities[0]}"' if entities else ""]
    direct = sum(c.direct for c in items)
    debug = stats | {"candidates": len(items), "direct": direct, "expanded": len(items) - direct, "packed": len(packed), "documents": len(paths), "diversity": round(len(paths) / len(packed), 4) if packed else 0.0}
    return Context(query, budget, used, strategy, packed, kind, redundant, truncated, skipped, known, [h for h in hints if h][:3], run.diagnostic, debug, picks)
