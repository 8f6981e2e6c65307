"""JSON files with limits, and records of agent runs."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_LENGTH = 50 * 1024 * 1024, 100, 2_000_000, 1_000_000


class LimitError(ValueError):
    pass


def check_limits(value: Any, depth: int = MAX_DEPTH, nodes: int = MAX_NODES, length: int = MAX_LENGTH) -> Any:
    """Walks a value without recursion; raises LimitError where it is too deep, too large or a list too long."""
    seen, stack = 0, [(value, 0)]
    while stack:
        v, d = stack.pop()
        seen += 1
        if seen > nodes:
            raise LimitError(f"over {nodes} values")
        if isinstance(v, (dict, list)):
            if d >= depth:
                raise LimitError(f"deeper than {depth}")
            if isinstance(v, list) and len(v) > length:
                raise LimitError(f"a list of over {length}")
            stack += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return value


def read_json(path: str, max_bytes: int = MAX_BYTES) -> Any:
    size = os.path.getsize(path)
    if size > max_bytes:
        raise LimitError(f"{path} has {size} bytes; the limit is {max_bytes}")
    with open(path, encoding="utf-8") as f:
        return check_limits(json.load(f))


MODES = ("with_graph", "without_graph")
RUN_SCHEMA = (
    "id string, questionId string, question string, mode string, startedAt string, completedAt string, "
    "toolCalls array<struct<name: string, outputChars: double>>, directFileReads array<struct<path: string, chars: double>>, "
    "textSearches array<struct<query: string, resultCount: double>>, graphCalls array<struct<tool: string, query: string, resultCount: double, chars: double>>, "
    "finalCitations array<struct<path: string, line: int, correct: boolean>>, rawFileFallback boolean, tokenEstimate double, characterBudget double, latencyMs double, notes array<string>"
)
_ITEMS = {"toolCalls": ("name",), "directFileReads": ("path",), "textSearches": ("query",), "graphCalls": ("tool",), "finalCitations": ("path",)}
_NUMBERS = ("outputChars", "chars", "resultCount", "tokenEstimate", "characterBudget", "latencyMs")


def validate_runs(value: Any) -> list[dict]:
    """Run records, checked field by field; errors name the record and the item."""
    if isinstance(value, dict) and isinstance(value.get("runs"), list):
        value = value["runs"]
    if not isinstance(value, list):
        raise ValueError("a list of run records, or an object with a list of runs, was expected")
    for i, r in enumerate(value):
        where = f"run record {i}"
        if not isinstance(r, dict):
            raise ValueError(f"{where} must be an object")
        for k in ("id", "questionId", "question", "mode", "startedAt", "completedAt"):
            if not isinstance(r.get(k), str) or not r[k].strip():
                raise ValueError(f"{where}: {k} must be text")
        if r["mode"] not in MODES:
            raise ValueError(f"{where}: mode must be {' or '.join(MODES)}")
        if not isinstance(r.get("rawFileFallback"), bool):
            raise ValueError(f"{where}: rawFileFallback must be true or false")
        if "latencyMs" not in r:
            raise ValueError(f"{where}: latencyMs is missing")
        for name, needed in _ITEMS.items():
            items = r.get(name)
            if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
                raise ValueError(f"{where}: {name} must be a list of objects")
            for j, item in enumerate(items):
                for k in needed:
                    if not isinstance(item.get(k), str) or not item[k].strip():
                        raise ValueError(f"{where}, {name} {j}: {k} must be text")
                _check_numbers(item, f"{where}, {name} {j}")
                if item.get("line") is not None and (not isinstance(item["line"], int) or item["line"] < 1):
                    raise ValueError(f"{where}, {name} {j}: line must be a positive number")
        _check_numbers(r, where)
    return value


def _check_numbers(item: dict, where: str) -> None:
    for k in _NUMBERS:
        v = item.get(k)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0):
            raise ValueError(f"{where}: {k} must be a number from 0")


def runs(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([json.dumps(r) for r in records], "string").selectExpr(f"from_json(value, '{RUN_SCHEMA}') AS r").select("r.*") if records else spark.createDataFrame([], RUN_SCHEMA)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs(spark, validate_runs(read_json(path)))
