"""One object for a project: index, search, context, trace, query, health, exports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .model import Config, GraphTables
from .operators import context as ctx
from .operators import evaluate, export, graph, health, related
from .operators import search as srch
from .operators.build import now
from .operators.diff import GraphDiff, graph_diff
from .operators.nodes import Resolution, all_nodes, edge_owner, edges_of, node_text, resolve_node
from .plans import dsl
from .session import materialize
from .sources import git
from .sources.markdown import list_files, parse_files
from .sources.store import GraphStore, counts

MAX_QUERY, MAX_KNOWN_FILES = 10_000, 20
STATE = ".quillgraph"


class Project:
    """A folder of Markdown and its index, which lies in ``store`` (below the folder where none is given)."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, store: str | None = None):
        self.spark, self.root = spark, root
        self.config = config or load_config(root)
        self.store = GraphStore(spark, store or f"{root.rstrip('/')}/{STATE}")
        self._graph: GraphTables | None = None

    # ---------------------------------------------------------------- indexing
    def files(self) -> DataFrame:
        return list_files(self.spark, self.root, self.config)

    def parsed(self) -> DataFrame:
        return parse_files(self.files())

    def current(self) -> DataFrame:
        """The files as they are now; those that the index knows are not parsed again."""
        about = self.store.current()
        if about is None or not about["parsed"]:
            return self.parsed()
        same, fresh = self.store.reparse(self.files(), parse_files)
        return same.unionByName(fresh)

    def index(self, full: bool = False) -> dict[str, int]:
        if full or self.store.current() is None:
            self._graph = self.store.index(self.parsed(), self.config, now())
            return {"parsed": self._graph.extra["parsed"].count(), "kept": 0, "deleted": 0}
        self._graph, done = self.store.refresh(self.files(), self.config, now())
        return done

    @property
    def graph(self) -> GraphTables:
        if self._graph is None:
            self._graph = self.store.load()
        return self._graph

    def status(self) -> dict:
        if self.store.current() is None:
            return {"indexed": False}
        g = self.graph
        return {"indexed": True, "indexed_at": g.documents.agg(F.max("indexed_at")).first()[0], "bytes": self.store.size()} | counts(g)

    def storage(self) -> dict:
        """What the index holds and where it is large."""
        g = self.graph
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  bounded: first folders, kinds of edges, ten nodes, kinds of vectors
        return {
            "bytes": self.store.size(), "path_groups": rows(health.path_groups(g).limit(20)), "edge_kinds": rows(graph.edge_kind_stats(g.edges).orderBy("kind")),
            "high_degree": rows(health.high_degree(g).orderBy(F.desc("degree"), "id")), "vectors": rows(health.vector_profiles(g).orderBy("provider", "model", "dimensions")),
        }

    def freshness(self) -> DataFrame:
        """path, reason of files that are newer than the index, new or gone; contents are not read."""
        files = self.files().select("path", F.col("modified"), F.lit(True).alias("there"))
        docs = self.graph.documents.select("path", F.to_timestamp("indexed_at").alias("at"), F.lit(True).alias("known"))
        both = files.join(docs, "path", "full_outer")
        reason = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "deleted").when(F.col("modified") > F.col("at") + F.expr("INTERVAL 1 MILLISECOND"), "modified")
        return both.select("path", reason.alias("reason")).where("reason IS NOT NULL").orderBy("path")

    # ----------------------------------------------------------------- queries
    def search(self, query: str, limit: int | None = None, mode: str = "auto", semantic: bool | None = None) -> srch.SearchRun:
        return srch.search(self.graph, checked(query), self.config, limit, mode, semantic)

    def context(self, query: str, **options) -> ctx.Context:
        if len(options.get("known_files") or []) > MAX_KNOWN_FILES:
            raise ValueError(f"at most {MAX_KNOWN_FILES} known files")
        return ctx.build_context(self.graph, checked(query), self.config, **options)

    def node(self, query: str) -> tuple[Resolution, DataFrame | None]:
        """The node, and its edges with the labels of their other ends."""
        found = resolve_node(self.graph, checked(query))
        if found.status != "found":
            return found, None
        near = edges_of(self.graph, [found.node["id"]])
        labels = all_nodes(self.graph).select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), "label")
        return found, near.join(labels, "other", "left").orderBy(F.desc("weight"), F.desc("confidence"), "id")

    def trace(self, start: str, end: str, max_depth: int = 6) -> dict:
        a, b = resolve_node(self.graph, checked(start)), resolve_node(self.graph, checked(end))
        if a.status != "found" or b.status != "found":
            which = ("start", start) if a.status != "found" else ("end", end)
            return {"from": start, "to": end, "found": False, "steps": [], "message": f"The {which[0]} wasn't found: {which[1]}"}
        names = {"from": a.node["label"], "to": b.node["label"]}
        path = graph.shortest_path(self.graph.edges, a.node["id"], b.node["id"], max_depth)
        if path is None:
            return names | {"found": False, "steps": [], "message": f"There is no path of at most {max_depth} steps."}
        ids = list({x for s in path for x in (s["a"], s["b"])})
        labels = {r["id"]: r["label"] for r in all_nodes(self.graph).where(F.col("id").isin(ids)).orderBy(F.desc("order")).collect()} if ids else {}  # at most max_depth + 1
        rows = {r["id"]: r for r in self.graph.edges.where(F.col("id").isin([s["edge"] for s in path])).collect()} if path else {}
        steps = []
        for s in path:
            e = rows[s["edge"]]
            steps.append({"from_id": s["a"], "from_label": labels.get(s["a"], s["a"]), "to_id": s["b"], "to_label": labels.get(s["b"], s["b"]), "edge_from": e["from_id"], "edge_to": e["to_id"], "kind": e["kind"], "direction": "forward" if e["from_id"] == s["a"] else "reverse", "confidence": e["confidence"], "provenance": e["provenance"]})
        return names | {"found": True, "steps": steps}

    def reach(self, start: str, max_depth: int = 2) -> DataFrame:
        """id, depth, parent of the nodes within some hops of one."""
        found = resolve_node(self.graph, checked(start))
        if found.status != "found":
            raise ValueError(f"the start wasn't found: {start}")
        return graph.bfs(self.graph.edges, self.spark.createDataFrame([(found.node["id"],)], "id string"), max_depth)

    def semantic_status(self) -> str:
        return evaluate.semantic_status(self.graph, self.config.provider, self.config.embedding_model, self.config.dimensions, self.config.semantic, vectors.known_providers())

    def query(self, source: str) -> tuple[DataFrame, DataFrame]:
        """(all documents that match, the ordered and limited ones)."""
        q = dsl.parse(source)
        used = dsl.predicates(q.where)
        g = self.graph
        owner = edge_owner(g) if any(p.field.startswith("edge") for p in used) else None
        text = node_text(g) if any(p.field == "edge_target" for p in used) else None
        states = None
        if any(p.field == "health" for p in used):
            states = health.health_states(self.doctor(), g)
        return dsl.execute(q, g.documents, edge_owner=owner, node_text=text, health=states)

    # ------------------------------------------------------------------ health
    def doctor(self, scope: health.Scope | None = None) -> health.Report:
        files = git.all_files(self.spark, self.root) if "://" not in self.root else None
        report = health.run_doctor(materialize(self.current()), self.graph, self.config, files, scope)
        if report.is_stale:
            report.parts = {}
        return report

    def derive(self, options: related.Options | None = None, dry_run: bool = False) -> related.Derivation:
        parsed = materialize(self.current())
        stale = not health.stale_index(parsed, self.graph.documents).isEmpty() or not parsed.where("error IS NOT NULL").isEmpty()
        found = related.derive_related(self.graph, self.config, options, now(), stale)
        if not dry_run:
            self._graph = self.store.replace_related(found.edges)
        return found

    def diff(self, base: str) -> GraphDiff:
        """Against a revision of the repository that the project lies in."""
        files, paths = git.snapshot_files(self.spark, self.root, base, self.config)
        old = GraphStore(self.spark, f"{self.store.root}/base-{git.revision(self.root, base)}").index(parse_files(files), self.config, now())
        before = health.run_doctor(old.extra["parsed"], old, self.config, paths).warnings
        return graph_diff(old, self.graph, git.renames(self.root, base), before, self.doctor().warnings)

    # ----------------------------------------------------------------- exports
    def graph_json(self) -> dict:
        return export.graph_json(self.graph, self.config)

    def mermaid(self, start: str, end: str, max_depth: int = 6) -> str:
        return export.mermaid(self.trace(start, end, max_depth))

    def freshness_note(self, paths: list[str]) -> str | None:
        """A warning where the index is older than the files, those of an answer first."""
        found = [r["path"] for r in self.freshness().limit(1000).collect()]
        if not found:
            return None
        own = [p for p in found if p in set(paths)]
        return f"The index is older than {len(found)} file(s)" + (f", among them {', '.join(own[:5])} of this answer." if own else ".")


def checked(text: str) -> str:
    if not text or not text.strip():
        raise ValueError("a query can't be empty")
    if len(text) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    return text


def load_config(root: str) -> Config:
    path = os.path.join(root, STATE, "config.json")
    if "://" in root or not os.path.isfile(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return Config().merged(json.load(f))


def init_project(root: str) -> bool:
    """Writes the default settings and an ignore rule where there are none; true where settings were written."""
    folder = os.path.join(root, STATE)
    os.makedirs(folder, exist_ok=True)
    path, ignore = os.path.join(folder, "config.json"), os.path.join(root, ".gitignore")
    fresh = not os.path.exists(path)
    if fresh:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({k: list(v) if isinstance(v, tuple) else v for k, v in Config().__dict__.items()}, f, indent=2)
    text = ""
    if os.path.exists(ignore):
        with open(ignore, encoding="utf-8") as f:
            text = f.read()
    if f"{STATE}/" not in text.split():
        with open(ignore, "a", encoding="utf-8") as f:
            f.write(("" if not text or text.endswith("\n") else "\n") + f"{STATE}/\n")
    return fresh
