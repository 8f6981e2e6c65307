import dataclasses
import os
import subprocess

import corpus
import pytest
from pyspark.sql import functions as F

from quillgraph.api import Project, init_project
from quillgraph.functions.ids import stable_id_py
from quillgraph.model import Config
from quillgraph.operators import export, health
from quillgraph.operators.diff import diff_documents
from quillgraph.operators.evaluate import Case, evaluate_retrieval, semantic_status
from quillgraph.sources.store import GraphStore

CACHE, LOGIN, OLD = (stable_id_py("document", x) for x in ("cache-design", "login-design", "old-login"))


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = corpus.write(tmp_path_factory.mktemp("project"))
    p = Project(spark, root, Config(semantic=True))
    p.index()
    return p


def test_files_and_documents(project):
    rows = {r["path"]: r for r in project.graph.documents.collect()}
    assert set(rows) == {"docs/cache.md", "docs/login.md", "docs/old.md", "docs/adr/adr-1.md", "docs/guide.md", "notes/会話.md"}
    assert rows["docs/login.md"]["id"] == LOGIN and rows["docs/login.md"]["trust_tier"] == "validated"
    assert rows["docs/guide.md"]["title"] == "Guide" and rows["docs/guide.md"]["type"] == "other" and rows["docs/guide.md"]["id"] == stable_id_py("document", "docs/guide.md")


def test_entities(project):
    rows = {(r["kind"], r["name"]) for r in project.graph.entities.collect()}
    for e in [("error_code", "CacheTimeoutError"), ("symbol", "LoginService"), ("config_key", "CACHE_TTL_SECONDS"), ("api_route", "GET /cache/{key}"), ("error_code", "ERR_CACHE_404"), ("symbol", "SessionRenewer"), ("symbol", "EvictionPolicy"), ("symbol", "UnknownThing")]:
        assert e in rows
    assert not any(n in ("GET", "Ignore", "the cache") for _, n in rows)


def test_edges(project):
    e = {(r["from_id"], r["kind"], r["to_id"]): r for r in project.graph.edges.collect()}
    assert (LOGIN, "DEPENDS_ON", CACHE) in e and e[LOGIN, "DEPENDS_ON", CACHE]["confidence"] == 1.0
    assert e[LOGIN, "DEPENDS_ON", stable_id_py("entity", "symbol:unknownthing")]["confidence"] == 0.85
    assert (OLD, "DEPRECATED_BY", LOGIN) in e
    refresh = stable_id_py("section", f"{LOGIN}:session-refresh")
    assert (refresh, "LINKS_TO", stable_id_py("section", f"{CACHE}:expiry")) in e and (refresh, "LINKS_TO", CACHE) in e
    assert (LOGIN, "IMPLEMENTS", stable_id_py("source_ref", "src/login/service.ts")) in e and (LOGIN, "REFERENCES_SOURCE", stable_id_py("source_ref", "src/cache/store.ts")) in e
    ids = [r["id"] for r in project.graph.edges.collect()]
    assert len(ids) == len(set(ids))


def test_search_finds_definitions_first(project):
    run = project.search("where is `CacheTimeoutError` defined", semantic=False)
    rows = run.results.collect()
    assert rows[0]["path"] == "docs/cache.md" and rows[0]["rank"] == 1 and rows[0]["score"] > 200
    assert "definition#" in rows[0]["reason"] and rows[0]["entities"][0]["name"] == "CacheTimeoutError"
    assert run.matched[0]["documents"] == 2
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_search_by_words_and_vectors(project):
    assert project.search("sessions store", mode="keyword").results.collect()[0]["path"] in ("docs/adr/adr-1.md", "docs/guide.md")
    rows = project.search("ユーザー認証", semantic=False).results.collect()
    assert [r["path"] for r in rows] == ["notes/会話.md"]
    run = project.search("refreshes a session", mode="semantic")
    assert run.diagnostic is None and any(r["similarity"] for r in run.results.collect())
    other = dataclasses.replace(project.config, dimensions=64)
    assert Project(project.spark, project.root, other).search("session").diagnostic["code"] == "vectors_unavailable"
    assert project.search("!!", semantic=False).results.count() == 0


def test_context(project):
    c = project.context("How does `LoginService` handle `CacheTimeoutError`?", semantic=False)
    paths = [i.path for i in c.items]
    assert {"docs/login.md", "docs/cache.md"} <= set(paths) and c.used_chars == sum(len(i.content) for i in c.items)
    assert any(r["path"] == "src/login/Service.ts" for i in c.items for r in i.source_refs)
    assert any("validated" in r for i in c.items for r in i.risks)
    old = next((i for i in project.context("Old Login passwords", semantic=False).items if i.path == "docs/old.md"))
    assert any("deprecated" in r for r in old.risks) and any("prompt injection" in r for r in old.risks)
    small = project.context("session", max_chars=60, semantic=False)
    assert small.used_chars <= 60 and small.items[-1].content.endswith("...")
    known = project.context("session", known_files=["src/cache/Store.ts"], semantic=False)
    assert any(i.reason.startswith("known file") for i in known.items) and any(s.startswith("trace") for s in known.suggestions)
    m = project.context("session", strategy="mmr")
    assert m.similarity == "embedding-cosine" and m.selections[0]["redundancy"] == 0


def test_nodes_and_traces(project):
    assert project.node("docs/cache.md#expiry")[0].node["label"] == "Expiry"
    assert project.node("login design")[0].node["id"] == LOGIN
    assert project.node("src/cache/store.ts")[0].node["kind"] == "source_ref"
    assert project.node("EvictionPolicy")[0].node["kind"] == "entity"
    assert project.node("nothing at all")[0].status == "not_found"
    assert project.node("Login Design")[1].count() > 3
    t = project.trace("Login Design", "src/cache/Store.ts")
    assert t["found"] and len(t["steps"]) == 1 and t["steps"][0]["kind"] == "REFERENCES_SOURCE"
    t = project.trace("Old Login", "Cache Design")
    assert [s["kind"] for s in t["steps"]] == ["DEPRECATED_BY", "DEPENDS_ON"] and t["steps"][0]["direction"] == "forward"
    assert project.trace("Cache Design", "Cache Design")["steps"] == []
    assert not project.trace("notes/会話.md", "Cache Design")["found"] and "start" in project.trace("?!", "Cache Design")["message"]
    assert "flowchart LR" in project.mermaid("Old Login", "Cache Design") and "DEPENDS_ON / frontmatter / 1.00" in project.mermaid("Old Login", "Cache Design")


@pytest.mark.parametrize(
    "source, paths",
    [
        ("type = design", {"docs/cache.md", "docs/login.md"}),
        ("type = design AND tag = AUTH", {"docs/login.md"}),
        ("edge = DEPENDS_ON", {"docs/login.md"}),
        ("edge.LINKS_TO ~ login", {"docs/guide.md"}),
        ("status = deprecated OR title ~ adr", {"docs/old.md", "docs/adr/adr-1.md"}),
        ("health = dead_link", {"docs/login.md"}),
        ("health = orphan", {"docs/adr/adr-1.md"}),
        ("NOT (status = active)", {"docs/old.md"}),
        ("health = content_risk", {"docs/old.md"}),
    ],
)
def test_filters(project, source, paths):
    hits, _ = project.query(source)
    got = {r["path"] for r in hits.collect()}
    assert got == paths or (source == "health = orphan" and paths <= got)


def test_doctor(project):
    report = project.doctor()
    assert not report.is_stale
    rows = report.warnings.collect()
    by = {}
    for r in rows:
        by.setdefault(r["code"], []).append(r)
    assert {r["message"].rsplit(": ", 1)[1] for r in by["link.dead"]} == {"missing.md", "[[nowhere]]"}
    assert [r["label"] for r in by["source_ref.missing"]] == ["src/login/Service.ts"]
    assert [r["path"] for r in by["document.deprecated_referenced"]] == ["docs/guide.md"]
    assert [r["path"] for r in by["document.superseded_referenced"]] == ["docs/guide.md"] and "docs/login.md" in by["document.superseded_referenced"][0]["message"]
    assert [r["path"] for r in by["graph.missing_decision_link"]] == ["docs/adr/adr-1.md"]
    assert [r["path"] for r in by["definition.missing"]] == ["docs/adr/adr-1.md"]
    assert [r["path"] for r in by["tag.invalid_format"]] == ["docs/login.md"]
    assert by["content.risk"][0]["line"] == 3
    assert [r["severity"] for r in rows] == sorted((r["severity"] for r in rows), key=["error", "warn", "info"].index)
    assert health.gate(report, "error") == 1 and health.gate(report) == 0
    scoped = project.doctor(health.Scope("changed", changed=("docs/adr/adr-1.md",)))
    assert {r["path"] for r in scoped.warnings.collect()} == {"docs/adr/adr-1.md"}


def test_incremental_refresh(spark, tmp_path):
    root = corpus.write(tmp_path)
    p = Project(spark, root)
    assert p.index() == {"parsed": 6, "kept": 0, "deleted": 0}
    assert p.index() == {"parsed": 0, "kept": 6, "deleted": 0}
    os.remove(tmp_path / "docs/old.md")
    (tmp_path / "docs/guide.md").write_text("# Guide\n\nNow shorter.\n")
    (tmp_path / "docs/new.md").write_text("# New\n")
    assert p.doctor().is_stale
    assert {(r["path"], r["reason"]) for r in p.doctor().stale.collect()} == {("docs/old.md", "deleted"), ("docs/guide.md", "modified"), ("docs/new.md", "added")}
    assert {r["reason"] for r in p.freshness().collect()} >= {"added", "deleted"}
    assert p.index() == {"parsed": 2, "kept": 4, "deleted": 1}
    fresh = Project(spark, root, store=str(tmp_path / "other"))
    fresh.index(full=True)
    for name, df in p.graph.items():
        drop = [c for c in ("created_at", "indexed_at") if c in df.columns]
        assert sorted(map(str, df.drop(*drop).collect())) == sorted(map(str, getattr(fresh.graph, name).drop(*drop).collect()))
    assert p.store.prune() == 1 and p.store.load().documents.count() == 6


def test_exports(project, tmp_path):
    value = project.graph_json()
    assert export.verify_graph_json(value) == ([], ["Edges of chunks are not exported."])
    assert value == project.graph_json()
    broken = value | {"nodes": value["nodes"][1:] + value["nodes"][-1:]}
    codes = {e.code for e in export.verify_graph_json(broken)[0]}
    assert {"graphjson.node_duplicate", "graphjson.edge_endpoint", "graphjson.graph_hash"} <= codes
    assert export.verify_graph_json([])[0][0].code == "graphjson.not_object"
    index = {r["path"]: r for r in export.docs_index(project.graph).collect()}
    assert index["docs/login.md"]["outbound"] == ["docs/cache.md"] and index["docs/cache.md"]["inbound"] == ["docs/login.md"]
    assert "LoginService" in index["docs/login.md"]["defines"]
    assert "### [[docs/cache.md]]" in export.render_markdown_index(project.graph, "h")
    artifact = project.spark.createDataFrame([("src\\cache\\Store.ts", [("b", None), ("a", "class")]), (None, None)], "path string, symbols array<struct<name: string, kind: string>>")
    hit, miss = export.source_bridge(project.graph, artifact)
    assert [(r["source_ref"], [s["name"] for s in r["symbols"]]) for r in hit.collect()] == [("src/cache/Store.ts", ["a", "b"])] and [r[0] for r in miss.collect()] == ["src/login/Service.ts"]
    folder = str(tmp_path / "bundle")
    export.create_bundle(project.graph, folder, project.config)
    assert export.verify_bundle(project.spark, folder, project.graph, project.config) == ([], True)
    export.write_graph_json(project.graph, str(tmp_path / "lines"))
    assert project.spark.read.text(str(tmp_path / "lines/nodes")).count() == len(value["nodes"])


def test_differences(spark, project, tmp_path):
    files = dict(corpus.FILES)
    files["docs/moved.md"] = files.pop("docs/guide.md") + "\nmore\n"
    files["docs/old.md"] = files["docs/old.md"].replace("deprecated\n", "archived\n")
    del files["docs/adr/adr-1.md"]
    other = Project(spark, corpus.write(tmp_path, files))
    other.index()
    rows = {r["path"]: r for r in diff_documents(project.graph, other.graph, {"docs/guide.md": "docs/moved.md"}).collect()}
    assert {p: r["change"] for p, r in rows.items()} == {"docs/moved.md": "renamed", "docs/old.md": "modified", "docs/adr/adr-1.md": "deleted"}
    assert rows["docs/old.md"]["status_changed"] and rows["docs/moved.md"]["previous_path"] == "docs/guide.md" and rows["docs/adr/adr-1.md"]["section_delta"] == -1


def test_difference_from_a_revision(spark, tmp_path):
    root = corpus.write(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "docs/new.md").write_text("# a new page\n")
    p = Project(spark, root)
    p.index()
    found = p.diff("HEAD")
    assert found.summary() == {"added": 1, "modified": 0, "deleted": 0, "renamed": 0, "sections": 1, "source_refs": 0, "edges": 2}
    assert {r["code"] for r in found.warnings.collect()} == {"document.orphan"}


def test_retrieval_evaluation(project):
    cases = [Case("1", "`LoginService` session refresh", ("docs/login.md",), (("docs/login.md", "Session Refresh"),), source_refs=("src/login/Service.ts",), trace=("Old Login", "Cache Design", 6)), Case("2", "zzz", ("docs/none.md",))]
    results, summary = evaluate_retrieval(cases, lambda q: project.context(q, semantic=False), project.trace)
    assert [r.passed for r in results] == [True, False] and summary["passed"] == 1 and results[1].missing == ["docs/none.md"]


def test_semantic_status(project):
    g, c = project.graph, project.config
    ask = lambda **k: semantic_status(g, **({"provider": c.provider, "model": c.embedding_model, "dimensions": c.dimensions, "enabled": True, "known": ["local-hash"]} | k))
    assert ask() == "ready" and ask(enabled=False) == "disabled" and ask(provider="x") == "unsupported_provider" and ask(dimensions=7) == "needs_reindex"


def test_init(tmp_path):
    assert init_project(str(tmp_path)) and not init_project(str(tmp_path))
    assert (tmp_path / ".gitignore").read_text().count(".quillgraph/") == 1


def test_nothing_indexed(spark, tmp_path):
    p = Project(spark, str(tmp_path))
    assert p.status() == {"indexed": False}
    with pytest.raises(Exception, match="nothing is indexed"):
        GraphStore(spark, str(tmp_path / "s")).load()


def test_status(project):
    s = project.status()
    assert s["documents"] == 6 and s["chunks"] == s["sections"] == s["chunk_vectors"] and s["bytes"] > 0
    groups = {r["path_group"]: r["documents"] for r in health.path_groups(project.graph).collect()}
    assert groups == {"docs": 5, "notes": 1}
    assert project.graph.edges.where(F.col("weight").isNull()).count() == 0
