"""Parts that the project tests pass by: the filter language's errors, front matter, boosts, derivation, providers."""

import dataclasses
import http.server
import json
import threading

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.api import Project
from quillgraph.functions import markdown as md
from quillgraph.functions import text as tx
from quillgraph.functions import vectors
from quillgraph.functions.http_embedding import http_embedder, register_http
from quillgraph.model import Config
from quillgraph.operators import fts, related
from quillgraph.operators.nodes import edges_of
from quillgraph.plans import dsl


@pytest.mark.parametrize(
    "source",
    ["", "title", "title =", "title = ", "nothing = x", "type = unheard", "updated >= soon", "title ~ 'x", "(type = adr", "type = adr)", "type = adr LIMIT 501", "type = adr LIMIT 0", "type > adr",
     "health = well", "edge = MADE_UP", "edge.MADE_UP ~ x", "type = adr ORDER BY nothing", "type = adr ORDER BY title, status, path, updated", "title = x" + " " * 10_000,
     " AND ".join(["title = x"] * 65), "(" * 25 + "title = x" + ")" * 25, "title = '" + "x" * 1001 + "'", "NOT", "title = x AND", "title = x; DROP TABLE d"],
)
def test_queries_that_are_refused(source):
    with pytest.raises(dsl.QueryError):
        dsl.parse(source)


def test_queries_at_their_limits():
    assert dsl.parse(" AND ".join(["title = x"] * 64)) and dsl.parse("(" * 20 + "title = x" + ")" * 20) and dsl.parse("type = adr LIMIT 500").limit == 500


@pytest.mark.parametrize(
    "block, codes",
    [("title: [a", {"invalid_yaml"}), ("- a\n- b", {"not_mapping"}), ("title: 7", {"invalid_field"}), ("type: novel", {"invalid_field"}), ("tags: [1]", {"invalid_field"}), ("title: a\ntags: [x]", set())],
)
def test_front_matter_codes(block, codes):
    found = md.split_front_matter(f"---\n{block}\n---\nbody")
    assert {d["code"] for d in found.diagnostics} == {f"front_matter.{c}" for c in codes} and found.body == "body"
    if codes == {"invalid_field"}:
        assert found.diagnostics[0]["line"] == 2


def test_front_matter_that_never_closes():
    found = md.split_front_matter("---\ntitle: a\n")
    assert [d["code"] for d in found.diagnostics] == ["front_matter.unclosed"] and found.body.startswith("---")


def test_markdown_blocks():
    got = md.parse_document("a/b.md", "Title\n=====\n\n    [no](link.md)\n\n~~~js\n# not a heading\n~~~\n\n> ## quoted\n\nSee [x](y.md \"t\") and ![img](z.md) `[c](d.md)` <https://e.org> [[Page#part|name]].\n\nSub\n---\n")
    assert [(s["heading"], s["level"]) for s in got["sections"] if s["heading"] in ("Title", "Sub")] == [("Title", 1), ("Sub", 2)]
    assert "y.md" in [x["url"] for x in got["links"]] and not {"link.md", "d.md", "z.md"} & {x["url"] for x in got["links"]}
    assert [(w["target"], w["anchor"], w["alias"]) for w in got["wiki_links"]] == [("Page", "part", "name")]
    assert [c["language"] for c in got["code_blocks"] if c["language"]] == ["js"] and [c["value"] for c in got["inline_code"]] == ["[c](d.md)"]


def test_slugs_agree(spark):
    given = ["  Hello, World!  ", "`code` -- x", "中文 Title", "---", "", "Ünïcode  and\ttabs", "a_b.c"]
    rows = spark.createDataFrame([(g,) for g in given], "s string").select("s", tx.slugify(F.col("s")).alias("slug")).collect()
    assert {r["s"]: r["slug"] for r in rows} == {g: tx.slugify_py(g) for g in given}


def test_boosts_of_trust_and_status(spark, tmp_path):
    page = lambda n, front: {f"docs/{n}.md": f"---\n{front}\n---\n# Page {n}\n\nzebra crossing {n}\n"}
    files = page("a", "trust_tier: validated") | page("b", "trust_tier: untrusted") | page("c", "status: deprecated") | page("d", "status: draft") | page("e", "title: e")
    p = Project(spark, corpus.write(tmp_path, files))
    p.index()
    got = {r["path"][5]: r["score"] - 1000 / (60 + int(r["reason"].split("fts#")[1].rstrip(")"))) for r in p.search("zebra", semantic=False).results.collect()}
    base = got["e"]
    assert {k: round(v - base, 2) for k, v in got.items()} == {"a": 3.0, "b": -35.0, "c": -20.0, "d": -8.0, "e": 0.0}


def test_stored_postings_give_the_same_scores(spark, tmp_path):
    files = dict(corpus.FILES)
    p = Project(spark, corpus.write(tmp_path, files))
    p.index()
    (tmp_path / "docs/guide.md").write_text("# Guide\n\nSession words, other sessions and a café.\n")
    p.index()
    (tmp_path / "docs/old.md").unlink()
    p.index()
    g = p.graph
    assert {(r["term"], r["id"], r["indexed"]) for r in g.extra["postings"].collect()} == {(r["term"], r["id"], r["indexed"]) for r in fts.postings(g.chunks, "id", "content").collect()}
    for query in ("session", "cafe words", "会話 保存", "zzz"):
        prefixes = tx.query_prefixes(query)
        close = lambda df: {r["id"]: pytest.approx(r["score"], abs=1e-9) for r in df.collect()}
        stored = {r["id"]: r["score"] for r in fts.bm25_postings(g.extra["postings"], g.extra["text_totals"], prefixes).collect()}
        assert stored == close(fts.bm25(g.chunks, "id", "content", prefixes, indexed=True))
    plan = fts.bm25_postings(g.extra["postings"], g.extra["text_totals"], ["session"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,session)" in plan


def test_a_refresh_without_changes_writes_nothing(spark, tmp_path):
    p = Project(spark, corpus.write(tmp_path))
    p.index()
    version = p.store.current()["version"]
    assert p.index() == {"parsed": 0, "kept": 6, "deleted": 0} and p.store.current()["version"] == version
    (tmp_path / "docs/guide.md").write_text("# Guide\n\nnew words\n")
    assert p.index() == {"parsed": 1, "kept": 5, "deleted": 0} and p.store.current()["version"] != version


def test_lookups_skip_what_they_dont_need(spark, tmp_path):
    p = Project(spark, corpus.write(tmp_path))
    p.index()
    ids = [r["id"] for r in p.graph.documents.limit(2).collect()]
    stored = edges_of(p.graph, ids)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert any(f.rsplit("/", 2)[1] == "adjacency" for f in stored.inputFiles()) and "In(node" in plan and "Exchange" not in plan
    bare = dataclasses.replace(p.graph, extra={})
    assert sorted(map(str, stored.select("node", "id", "other").collect())) == sorted(map(str, edges_of(bare, ids).select("node", "id", "other").collect()))


# ------------------------------------------------------------------ derivation
WORDS = {"cache": [1.0, 0.0, 0.0, 0.0], "login": [0.0, 1.0, 0.0, 0.0], "trees": [0.0, 0.0, 1.0, 0.0]}


def by_word(model, dimensions):
    def embed(texts):  # a closure, so that workers get it by value
        out = []
        for t in texts:
            v = np.array([0.0, 0.0, 0.0, 0.01])
            for w, axis in WORDS.items():
                v += t.lower().count(w) * np.array(axis)
            out.append(list(v / np.linalg.norm(v)))
        return out

    return embed


vectors.register_provider("by-word", by_word)


@pytest.fixture(scope="module")
def topics(spark, tmp_path_factory):
    text = lambda w, n: f"# {w} page {n}\n\n{w} {w}\n\n## More\n\nabout {w} {w} {w}\n"
    files = {f"docs/{w}-{n}.md": text(w, n) for w in ("cache", "login") for n in (1, 2)} | {"docs/trees-1.md": text("trees", 1), "docs/single.md": "# one\n\ncache\n"}
    p = Project(spark, corpus.write(tmp_path_factory.mktemp("topics"), files), Config(semantic=True, provider="by-word", embedding_model="m", dimensions=4))
    p.index()
    return p


def test_related_documents(topics):
    found = topics.derive()
    pairs = {(r["a_path"], r["b_path"]): r for r in found.pairs.collect()}
    assert set(pairs) == {("docs/cache-1.md", "docs/cache-2.md"), ("docs/login-1.md", "docs/login-2.md")}
    assert found.eligible == 5 and all(r["confidence"] > 0.99 and len(r["evidence"]) >= 2 for r in pairs.values())
    edges = topics.graph.edges.where("kind = 'RELATED_TO'").collect()
    assert len(edges) == 4 and {e["provenance"] for e in edges} == {"embedding_similarity"} and {(e["to_id"], e["from_id"]) for e in edges} == {(e["from_id"], e["to_id"]) for e in edges}
    again = topics.derive()
    assert topics.graph.edges.where("kind = 'RELATED_TO'").count() == 4 and again.pairs.count() == 2
    assert topics.search("login words", mode="semantic").results.first()["similarity"] > 0.9


def test_derivation_refuses(topics, monkeypatch):
    g, c = topics.graph, topics.config


    for code, config, stale in (
        ("embedding_disabled", dataclasses.replace(c, semantic=False), False), ("provider_not_semantic", dataclasses.replace(c, provider="local-hash"), False), ("stale_index", c, True),
        ("incomplete_vector_coverage", dataclasses.replace(c, dimensions=5), False),
    ):
        with pytest.raises(related.DerivationError) as e:
            related.derive_related(g, config, stale=stale)
        assert e.value.code == code
    monkeypatch.setattr(related, "MAX_PAIRS", 3)
    with pytest.raises(related.DerivationError) as e:
        related.derive_related(g, c)
    assert e.value.code == "corpus_too_large"
    with pytest.raises(related.DerivationError):
        related.Options(threshold=0.5)


def test_independent_pairs():
    assert related.independent([(0.9, "a", "x"), (0.95, "a", "y"), (0.9, "b", "x"), (0.9, "b", "y")], 4) == [(0.95, "a", "y"), (0.9, "b", "x")]


# ------------------------------------------------------------------- providers
class Handler(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        kind = self.path.strip("/")
        if kind == "slow":
            threading.Event().wait(3)
        if kind == "broken":
            self.send_response(503)
            self.end_headers()
            return
        reply = {"good": {"embeddings": [[1.0, len(t)] for t in asked["input"]]}, "zero": {"embeddings": [[0.0, 0.0]]}, "odd": {"no": 1}, "short": {"embeddings": [[1.0]]}}.get(kind, {})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def address():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_vectors_over_http(spark, address):
    register_http("over-http", f"{address}/good")
    df = spark.createDataFrame([("abc",), (None,), ("x",)], "t string").repartition(2)
    got = {r["t"]: list(r["v"]) for r in df.select("t", vectors.embed_column(F.col("t"), "over-http", "m", 2).alias("v")).collect()}
    assert got == {"abc": [1.0, 3.0], None: [1.0, 0.0], "x": [1.0, 1.0]}


@pytest.mark.parametrize("kind, code", [("broken", "http_error"), ("slow", "timeout"), ("odd", "invalid_response"), ("zero", "empty_vector"), ("short", "dimension_mismatch")])
def test_errors_over_http(address, kind, code):
    register_http("failing", f"{address}/{kind}", timeout=0.5)
    with pytest.raises(vectors.EmbeddingError) as e:
        vectors.provider("failing", "m", 2)(["t"])
    assert e.value.code == code


def test_providers_that_are_not_there():
    for call, code in ((lambda: http_embedder("ftp://x", "m", 2), "invalid_options"), (lambda: http_embedder("http://127.0.0.1:9", "m", 2, 1)(["t"]), "unavailable"), (lambda: vectors.provider("nobody", "m", 2), "unsupported_provider")):
        with pytest.raises(vectors.EmbeddingError) as e:
            call()
        assert e.value.code == code
