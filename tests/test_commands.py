"""The command line, the tools, the report."""

import io
import json

import corpus
import pytest

from quillgraph import __main__ as cli
from quillgraph import render
from quillgraph.api import Project
from quillgraph.operators.search import agent_context, agent_limit
from quillgraph.report import project_report, trend
from quillgraph.server import TOOLS, BadRequest, Server, validated
from quillgraph.sources import bounded


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = corpus.write(tmp_path_factory.mktemp("commands"))
    assert cli.main(["--root", path, "index"], spark) == 0
    return path


def ask(capsys, spark, root, *args, code=0):
    assert cli.main(["--root", root, *args], spark) == code
    return capsys.readouterr().out


def test_text_of_commands(spark, root, capsys):
    say = lambda *a, **k: ask(capsys, spark, root, *a, **k)
    assert "documents 6" in say("status", "--freshness", "--storage") and "up to date" in say("status", "--freshness")
    found = say("search", "where is `CacheTimeoutError`", "--explain")
    assert found.startswith("Query:") and "docs/cache.md#defines" in found and "CacheTimeoutError (error_code), in 2 documents" in found
    assert "Budget:" in say("context", "session `LoginService`", "--max-chars", "2000") and "docs/login.md" in say("query", "trust = validated")
    assert "Cache Design (document)" in say("node", "docs/cache.md") and "No node" in say("node", "zzz", code=1)
    assert "step(s)" in say("trace", "Old Login", "Cache Design") and "flowchart" in say("mermaid", "Old Login", "Cache Design")
    assert "[error] link.dead" in say("doctor", "--fail-on", "error", code=1)
    assert "disabled" in say("semantic") and "status --freshness" in say("usage")
    assert "Read [the old way]" in say("search", "caching") and say("search", "qqqq").strip() == "Nothing was found."


def test_json_of_commands(spark, root, capsys, tmp_path):
    say = lambda *a, **k: json.loads(ask(capsys, spark, root, "--json", *a, **k))
    assert say("status")["documents"] == 6 and say("query", "status = deprecated")["total"] == 1
    assert say("trace", "Old Login", "Cache Design")["found"] and say("search", "sessions", "--limit", "1")[0]["rank"] == 1
    graph = json.loads(ask(capsys, spark, root, "export", "graph"))
    (tmp_path / "g.json").write_text(json.dumps(graph))
    assert say("import", str(tmp_path / "g.json"))["errors"] == []
    (tmp_path / "g.json").write_text(json.dumps(graph | {"edges": []}))
    assert say("import", str(tmp_path / "g.json"), code=1)["errors"]
    assert len(json.loads(ask(capsys, spark, root, "export", "docs-index"))) == 6
    assert "### [[docs/cache.md]]" in ask(capsys, spark, root, "export", "markdown-index")
    assert say("bundle", "create", str(tmp_path / "b"))["counts"]["documents"] == 6
    assert say("bundle", "verify", str(tmp_path / "b")) == {"errors": [], "fresh": True}
    (tmp_path / "a.json").write_text(json.dumps({"files": [{"path": "src/cache/Store.ts", "symbols": [{"name": "Store"}]}]}))
    bridge = json.loads(ask(capsys, spark, root, "export", "source-bridge", "--artifact", str(tmp_path / "a.json")))
    assert [m["source_ref"] for m in bridge["matched"]] == ["src/cache/Store.ts"] and bridge["missing"] == ["src/login/Service.ts"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "query": "`LoginService` session", "expectedDocuments": ["docs/login.md"]}]))
    assert say("eval", str(tmp_path / "c.json"))["summary"]["passed"] == 1
    report = say("report", "--cases", str(tmp_path / "c.json"), "--bundle", str(tmp_path / "b"), "--out", str(tmp_path / "r.json"))
    assert report["evaluation"]["passed"] == 1 and report["bundle"] == {"errors": [], "fresh": True} and report["doctor"]["counts"]["link.dead"] == 2
    assert json.loads((tmp_path / "r.json").read_text())["counts"]["documents"] == 6
    assert len(report["doctor"]["top"]) <= 5 and report["doctor"]["top"][0]["count"] == max(report["doctor"]["counts"].values())


@pytest.mark.parametrize("args", [["search", "x", "--limit", "0"], ["trace", "a", "b", "--depth", "-1"], ["search", "x", "--mode", "other"], ["nothing"]])
def test_arguments_are_checked(args):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(args)


def test_errors_have_a_code_of_their_own(spark, root, capsys, tmp_path):
    ask(capsys, spark, root, "query", "type =", code=2)
    ask(capsys, spark, root, "search", " ", code=2)
    ask(capsys, spark, root, "context", "x", *[x for i in range(21) for x in ("--known-file", f"f{i}")], code=2)
    ask(capsys, spark, root, "export", "source-bridge", code=2)
    ask(capsys, spark, root, "eval", str(tmp_path / "none.json"), code=2)


def test_trend(tmp_path):
    assert trend(None) == {"state": "first_run"} and trend(str(tmp_path / "x"))["state"] == "previous_report_missing"
    (tmp_path / "x").write_text("{}")
    assert trend(str(tmp_path / "x"))["state"] == "previous_report_loaded"


def test_report_without_an_index(spark, tmp_path):
    r = project_report(Project(spark, str(tmp_path)))
    assert not r["indexed"] and "Index the project" in render.report(r)


def test_agent_limits():
    assert [agent_limit("a b", n)[0] for n in (1, 100, 1000)] == [8, 12, 16]
    assert agent_limit("one two three four five six seven", 1000)[0] == 20 and agent_limit("x" * 81, 5)[0] == 12 and agent_limit("a", 5000, 20)[0] == 24
    from quillgraph.model import Config

    small = agent_context("a", 5, Config(), [], None)
    assert (small["max_depth"], small["max_chars"]) == (2, 16_000)
    assert agent_context("a", 5, Config(), ["f"], 99)["max_depth"] == 3 and agent_context("a", 5, Config(), ["f"], 99)["max_chars"] == 99


def test_tools(spark, root):
    server = Server(Project(spark, root))
    send = lambda **m: server.answer(json.dumps({"jsonrpc": "2.0"} | m))
    call = lambda name, **a: send(id=1, method="tools/call", params={"name": name, "arguments": a})
    text = lambda reply: reply["result"]["content"][0]["text"]
    assert [t["name"] for t in send(id=1, method="tools/list")["result"]["tools"]] == ["search", "context", "node", "trace", "status"] and len(TOOLS) == 5
    assert send(id="a", method="initialize")["result"]["serverInfo"]["name"] == "quillgraph" and send(id=2, method="ping")["result"] == {}
    assert send(method="initialized") is None and send(id=3, method="x/y")["error"]["code"] == -32601
    assert server.answer("{")["error"]["code"] == -32700 and server.answer("[]")["error"]["code"] == -32600
    assert send(id=4, method="resources/list")["result"] == {"resources": []}
    assert "docs/cache.md" in text(call("search", query="`CacheTimeoutError`")) and "Limit 8" in text(call("search", query="`CacheTimeoutError`"))
    assert "Query:" in text(call("search", query="sessions", limit=2, explain=True))
    assert "docs/login.md" in text(call("context", query="`LoginService`", knownFiles=["docs/cache.md"]))
    assert "Cache Design" in text(call("node", node="docs/cache.md")) and "step(s)" in text(call("trace", **{"from": "Old Login", "to": "Cache Design"}))
    assert "documents 6" in text(call("status"))
    out = io.StringIO()
    server.serve(io.StringIO('\n{"jsonrpc": "2.0", "id": 9, "method": "ping"}\n{"jsonrpc": "2.0", "method": "initialized"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 9, "result": {}}


@pytest.mark.parametrize(
    "name, given",
    [("none", {}), ("search", {}), ("search", []), ("search", {"query": " "}), ("search", {"query": "x" * 10_001}), ("search", {"query": "x", "limit": 0}), ("search", {"query": "x", "limit": True}),
     ("search", {"query": "x", "more": 1}), ("context", {"query": "x", "knownFiles": ["f"] * 21}), ("context", {"query": "x", "knownFiles": [1]}), ("trace", {"from": "a"}), ("search", {"query": "x", "explain": 1})],
)
def test_tool_arguments_are_checked(name, given):
    with pytest.raises(BadRequest):
        validated(name, given)


def test_a_stale_index_is_told(spark, tmp_path):
    root = corpus.write(tmp_path, {"docs/a.md": "# a page\n\nwords here\n"})
    p = Project(spark, root)
    p.index()
    assert p.freshness_note(["docs/a.md"]) is None
    (tmp_path / "docs/b.md").write_text("# more\n")
    (tmp_path / "docs/a.md").unlink()
    assert "2 file(s)" in p.freshness_note(["docs/a.md"]) and "docs/a.md" in p.freshness_note(["docs/a.md"])


# ------------------------------------------------------------- bounded sources
def test_limits_of_json(tmp_path):
    with pytest.raises(bounded.LimitError, match="deeper"):
        bounded.check_limits([[[1]]], depth=2)
    with pytest.raises(bounded.LimitError, match="values"):
        bounded.check_limits([1, 2, 3], nodes=3)
    with pytest.raises(bounded.LimitError, match="list"):
        bounded.check_limits([1, 2, 3], length=2)
    (tmp_path / "x.json").write_text('{"a": [1, {"b": null}]}')
    assert bounded.read_json(str(tmp_path / "x.json")) == {"a": [1, {"b": None}]}
    with pytest.raises(bounded.LimitError, match="bytes"):
        bounded.read_json(str(tmp_path / "x.json"), 5)


RUN = {
    "id": "r", "questionId": "q", "question": "why", "mode": "with_graph", "startedAt": "a", "completedAt": "b", "rawFileFallback": False, "latencyMs": 3, "toolCalls": [{"name": "t", "outputChars": 5}],
    "directFileReads": [{"path": "a.md", "chars": 2}], "textSearches": [{"query": "x"}], "graphCalls": [], "finalCitations": [{"path": "a.md", "line": 1, "correct": True}],
}


@pytest.mark.parametrize("change", [{"id": ""}, {"mode": "other"}, {"rawFileFallback": 1}, {"toolCalls": [{}]}, {"toolCalls": None}, {"latencyMs": -1}, {"finalCitations": [{"path": "a", "line": 0}]}, {"directFileReads": [{"path": "a", "chars": "2"}]}])
def test_run_records_are_checked(change):
    with pytest.raises(ValueError, match="run record 0"):
        bounded.validate_runs([RUN | change])


def test_runs_are_read(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"runs": [RUN, RUN | {"id": "s", "mode": "without_graph"}]}))
    rows = bounded.read_runs(spark, str(tmp_path / "r.json")).orderBy("id").collect()
    assert [r["mode"] for r in rows] == ["with_graph", "without_graph"] and rows[0]["toolCalls"][0]["outputChars"] == 5.0
    with pytest.raises(ValueError):
        bounded.validate_runs({"no": 1})
