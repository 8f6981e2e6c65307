"""Five tools for agents over standard input and output: JSON-RPC 2.0, a message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO, Any

from . import render
from .api import MAX_KNOWN_FILES, MAX_QUERY, Project
from .operators.search import agent_context, agent_limit, explain
from .sources.store import StoreError, counts

PROTOCOL, MAX_DEPTH, MAX_LIMIT, MAX_CHARS = "2024-11-05", 12, 100, 1_000_000
_PARSE, _REQUEST, _METHOD, _PARAMS, _INTERNAL = -32700, -32600, -32601, -32602, -32603


def _tool(name: str, about: str, required: tuple[str, ...], **properties: dict) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}}


def _text(about: str) -> dict:
    return {"type": "string", "minLength": 1, "maxLength": MAX_QUERY, "description": about}


def _number(about: str, most: int) -> dict:
    return {"type": "integer", "minimum": 1, "maximum": most, "description": about}


TOOLS = (
    _tool("search", "Sections of the documentation that answer a question, best first.", ("query",), query=_text("words, or names in backticks"), limit=_number("how many", MAX_LIMIT), explain={"type": "boolean", "description": "how the results came about"}),
    _tool("context", "What is known for a task, packed into a budget of characters.", ("query",), query=_text("the task"), maxChars=_number("the budget", MAX_CHARS), knownFiles={"type": "array", "items": _text("a path"), "maxItems": MAX_KNOWN_FILES, "description": "files already looked at"}),
    _tool("node", "One document, section, entity or source file, and its edges.", ("node",), node=_text("an id, path, title, heading or name")),
    _tool("trace", "How two nodes are connected.", ("from", "to"), **{"from": _text("where it begins"), "to": _text("where it ends"), "maxDepth": _number("most steps", MAX_DEPTH)}),
    _tool("status", "What is indexed, and whether it is up to date.", ()),
)


class BadRequest(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def validated(name: str, given: Any) -> dict:
    """The arguments of a call, held against the tool's schema."""
    tool = next((t for t in TOOLS if t["name"] == name), None)
    if tool is None:
        raise BadRequest(_PARAMS, f"there is no tool named {name}")
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise BadRequest(_PARAMS, "arguments must be an object")
    schema = tool["inputSchema"]
    if unknown := sorted(set(given) - set(schema["properties"])):
        raise BadRequest(_PARAMS, f"unknown arguments: {', '.join(unknown)}")
    for k in schema["required"]:
        if k not in given:
            raise BadRequest(_PARAMS, f"{k} is missing")
    for k, v in given.items():
        _check(k, v, schema["properties"][k])
    return given


def _check(name: str, v: Any, rule: dict) -> None:
    kind = rule["type"]
    if kind == "string" and not (isinstance(v, str) and v.strip() and len(v) <= rule["maxLength"]):
        raise BadRequest(_PARAMS, f"{name} must be text of at most {rule['maxLength']} characters")
    if kind == "integer" and (isinstance(v, bool) or not isinstance(v, int) or not rule["minimum"] <= v <= rule["maximum"]):
        raise BadRequest(_PARAMS, f"{name} must be a whole number from {rule['minimum']} to {rule['maximum']}")
    if kind == "boolean" and not isinstance(v, bool):
        raise BadRequest(_PARAMS, f"{name} must be true or false")
    if kind == "array":
        if not isinstance(v, list) or len(v) > rule["maxItems"]:
            raise BadRequest(_PARAMS, f"{name} must be a list of at most {rule['maxItems']}")
        for x in v:
            _check(name, x, rule["items"])


class Server:
    """Answers messages about one project."""

    def __init__(self, project: Project):
        self.project = project
        self.calls: dict[str, Callable[[dict], tuple[str, list[str]]]] = {"search": self.search, "context": self.context, "node": self.node, "trace": self.trace, "status": self.status}

    # each gives the text of an answer and the paths it speaks of
    def search(self, a: dict) -> tuple[str, list[str]]:
        limit, why = agent_limit(a["query"], counts(self.project.graph)["documents"], self.project.config.default_limit)
        run = self.project.search(a["query"], a.get("limit", limit))
        rows = [r.asDict(True) for r in run.results.collect()]  # at most limit
        text = render.search(rows) if "limit" in a else f"Limit {limit}: {why}\n\n{render.search(rows)}"
        return (render.explanation(explain(run)) + "\n\n" + text if a.get("explain") else text), [r["path"] for r in rows]

    def context(self, a: dict) -> tuple[str, list[str]]:
        known = a.get("knownFiles", [])
        mode = agent_context(a["query"], counts(self.project.graph)["documents"], self.project.config, known, a.get("maxChars"))
        why = mode.pop("why")
        found = self.project.context(a["query"], known_files=known, **mode)
        return f"{render.context(found)}\n\nSearch limit {mode['search_limit']}, depth {mode['max_depth']}: {why}", [i.path for i in found.items]

    def node(self, a: dict) -> tuple[str, list[str]]:
        found, edges = self.project.node(a["node"])
        rows = [r.asDict() for r in edges.limit(12).collect()] if edges is not None else []
        node = found.node and found.node.asDict()
        return render.node(found.status, a["node"], node, [c.asDict() for c in found.candidates], rows), [node["path"]] if node and node["path"] else []

    def trace(self, a: dict) -> tuple[str, list[str]]:
        return render.trace(self.project.trace(a["from"], a["to"], a.get("maxDepth", 6))), []

    def status(self, a: dict) -> tuple[str, list[str]]:
        return render.status(self.project.status()), []

    def call(self, name: str, arguments: Any) -> dict:
        given = validated(name, arguments)
        try:
            text, paths = self.calls[name](given)
            note = self.project.freshness_note(paths)
        except (StoreError, ValueError) as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": f"{note}\n\n{text}" if note else text}]}

    def answer(self, line: str) -> dict | None:
        """The reply to a message; None for notifications."""
        ident = None
        try:
            try:
                m = json.loads(line)
            except ValueError as e:
                raise BadRequest(_PARSE, "the message isn't JSON") from e
            if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
                raise BadRequest(_REQUEST, "the message isn't a request")
            if "id" not in m:
                return None
            ident, params = m["id"], m.get("params") or {}
            if not isinstance(params, dict):
                raise BadRequest(_PARAMS, "params must be an object")
            match m["method"]:
                case "initialize":
                    result: dict = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "0.1.0"}}
                case "ping":
                    result = {}
                case "tools/list":
                    result = {"tools": list(TOOLS)}
                case "tools/call":
                    result = self.call(str(params.get("name")), params.get("arguments"))
                case "resources/list":
                    result = {"resources": []}
                case "resources/templates/list":
                    result = {"resourceTemplates": []}
                case "prompts/list":
                    result = {"prompts": []}
                case other:
                    raise BadRequest(_METHOD, f"there is no method {other}")
            return {"jsonrpc": "2.0", "id": ident, "result": result}
        except BadRequest as e:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001  one failed call must not end the server
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": _INTERNAL, "message": f"{type(e).__name__}: {e}".splitlines()[0]}}

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if line.strip() and (reply := self.answer(line)) is not None:
                sink.write(json.dumps(reply, ensure_ascii=False, default=str) + "\n")
                sink.flush()
