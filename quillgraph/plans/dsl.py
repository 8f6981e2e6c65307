"""The structured filter language: text to syntax tree to a Spark Column.

    type = adr AND (status != draft OR tag ~ "cache") ORDER BY updated DESC LIMIT 20

OR binds weaker than AND, AND weaker than NOT.  Errors name the offset.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DOCUMENT_KINDS, EDGE_WEIGHTS, TRUST_TIERS

MAX_CHARS, MAX_TOKENS, MAX_PREDICATES, MAX_DEPTH = 10_000, 256, 64, 24
DEFAULT_LIMIT, MAX_LIMIT, MAX_SORTS = 50, 500, 3
HEALTH = frozenset("dead_link orphan stale_source_ref missing_definition weakly_linked possible_contradiction content_risk".split())
_ALIASES = {"trust_tier": "trust", "tags": "tag", "updated_at": "updated", "indexed_at": "indexed"}
_TEXT, _DATE, _ENUM = ("status", "path", "title", "tag"), ("updated", "indexed"), ("type", "trust")
SORTABLE = ("path", "title", "type", "status", "trust", "updated", "indexed")
_EQUAL, _LIKE, _ORDER = ("=", "!="), ("=", "!=", "~", "!~"), ("=", "!=", "<", "<=", ">", ">=")


class QueryError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} (at {offset})")
        self.offset = offset


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: str
    edge: str | None = None


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Query:
    where: object
    order: tuple[tuple[str, bool], ...] = ()  # field, descending
    limit: int = DEFAULT_LIMIT


@dataclass(frozen=True)
class _Token:
    kind: str  # word, string, op, punct
    text: str
    at: int


def tokenize(source: str) -> list[_Token]:
    if len(source) > MAX_CHARS:
        raise QueryError(f"a query has at most {MAX_CHARS} characters", MAX_CHARS)
    out: list[_Token] = []
    i = 0
    while i < len(source):
        ch = source[i]
        if ch.isspace():
            i += 1
            continue
        start = i
        if ch in "\"'":
            value, i = [], i + 1
            while i < len(source) and source[i] != ch:
                if source[i] == "\\" and i + 1 < len(source):
                    i += 1
                    value.append({"n": "\n", "r": "\r", "t": "\t"}.get(source[i], source[i]))
                else:
                    value.append(source[i])
                i += 1
            if i >= len(source):
                raise QueryError("a string isn't closed", start)
            i += 1
            out.append(_Token("string", "".join(value), start))
        elif source[i : i + 2] in ("!=", "!~", "<=", ">="):
            out.append(_Token("op", source[i : i + 2], start))
            i += 2
        elif ch in "=~<>:":
            out.append(_Token("op", "=" if ch == ":" else ch, start))
            i += 1
        elif ch in "(),":
            out.append(_Token("punct", ch, start))
            i += 1
        else:
            while i < len(source) and not source[i].isspace() and source[i] not in "\"'=~<>(),!" and not (source[i] == ":" and (not out or out[-1].kind != "op")):
                i += 1
            if i == start:
                raise QueryError(f"{ch!r} isn't expected", start)
            out.append(_Token("word", source[start:i], start))
        if len(out) > MAX_TOKENS:
            raise QueryError(f"a query has at most {MAX_TOKENS} tokens", start)
    return out


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.i, self.end, self.predicates = tokenize(source), 0, len(source), 0

    def peek(self) -> _Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def at(self) -> int:
        t = self.peek()
        return t.at if t else self.end

    def keyword(self, *names: str) -> bool:
        for k, name in enumerate(names):
            j = self.i + k
            if j >= len(self.tokens) or self.tokens[j].kind != "word" or self.tokens[j].text.upper() != name:
                return False
        self.i += len(names)
        return True

    def punct(self, ch: str) -> bool:
        t = self.peek()
        if t and t.kind == "punct" and t.text == ch:
            self.i += 1
            return True
        return False

    def query(self) -> Query:
        if not self.tokens:
            raise QueryError("the query is empty", 0)
        where = self.either(0)
        order: list[tuple[str, bool]] = []
        limit = DEFAULT_LIMIT
        if self.keyword("ORDER", "BY"):
            while True:
                at, t = self.at(), self.peek()
                name = _ALIASES.get(t.text.lower(), t.text.lower()) if t and t.kind == "word" else ""
                if name not in SORTABLE:
                    raise QueryError("a field to sort by was expected", at)
                self.i += 1
                order.append((name, self.keyword("DESC") or (self.keyword("ASC") and False)))
                if len(order) > MAX_SORTS:
                    raise QueryError(f"at most {MAX_SORTS} fields can be sorted by", at)
                if not self.punct(","):
                    break
        if self.keyword("LIMIT"):
            at, t = self.at(), self.peek()
            if not t or t.kind != "word" or not t.text.isdecimal() or not 1 <= int(t.text) <= MAX_LIMIT:
                raise QueryError(f"a limit from 1 to {MAX_LIMIT} was expected", at)
            limit = int(t.text)
            self.i += 1
        if self.peek():
            raise QueryError(f"{self.peek().text!r} isn't expected", self.at())
        return Query(where, tuple(order), limit)

    def either(self, depth: int) -> object:
        parts = [self.both(depth)]
        while self.keyword("OR"):
            parts.append(self.both(depth))
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self, depth: int) -> object:
        parts = [self.single(depth)]
        while self.keyword("AND"):
            parts.append(self.single(depth))
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def single(self, depth: int) -> object:
        if depth > MAX_DEPTH:
            raise QueryError(f"a query nests at most {MAX_DEPTH} deep", self.at())
        if self.keyword("NOT"):
            return Not(self.single(depth + 1))
        if self.punct("("):
            inner = self.either(depth + 1)
            if not self.punct(")"):
                raise QueryError("a closing parenthesis was expected", self.at())
            return inner
        return self.predicate()

    def predicate(self) -> Predicate:
        at, name = self.at(), self.peek()
        if not name or name.kind != "word":
            raise QueryError("a field was expected", at)
        self.i += 1
        op = self.peek()
        if not op or op.kind != "op":
            raise QueryError("an operator was expected", self.at())
        self.i += 1
        value_at, value = self.at(), self.peek()
        if not value or value.kind not in ("word", "string"):
            raise QueryError("a value was expected", value_at)
        self.i += 1
        self.predicates += 1
        if self.predicates > MAX_PREDICATES:
            raise QueryError(f"a query has at most {MAX_PREDICATES} predicates", at)
        return validate(name.text, op.text, value.text, at, value_at)


def validate(name: str, op: str, value: str, at: int = 0, value_at: int = 0) -> Predicate:
    field = _ALIASES.get(name.lower(), name.lower())

    def needs(ops: tuple[str, ...]) -> None:
        if op not in ops:
            raise QueryError(f"{field} takes {' '.join(ops)}, not {op}", at)

    if field in _ENUM:
        needs(_LIKE)
        known = DOCUMENT_KINDS if field == "type" else TRUST_TIERS
        if value.lower() not in known:
            raise QueryError(f"{value!r} is no {field}", value_at)
        return Predicate(field, op, value.lower())
    if field in _TEXT:
        needs(_LIKE)
        if not 1 <= len(value) <= 1000:
            raise QueryError("a value has 1 to 1000 characters", value_at)
        return Predicate(field, op, value)
    if field in _DATE:
        needs(_ORDER)
        try:
            if len(value) == 10:
                dt.date.fromisoformat(value)
            elif "T" in value:
                dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
            else:
                raise ValueError
        except ValueError:
            raise QueryError(f"{value!r} is no date", value_at) from None
        return Predicate(field, op, value)
    if field == "health":
        needs(_EQUAL)
        if value.lower() not in HEALTH:
            raise QueryError(f"{value!r} is no health state", value_at)
        return Predicate(field, op, value.lower())
    if field == "edge":
        needs(_EQUAL)
        if value.upper() not in EDGE_WEIGHTS:
            raise QueryError(f"{value!r} is no kind of edge", value_at)
        return Predicate("edge", op, value.upper(), value.upper())
    if field.startswith("edge."):
        needs(_LIKE)
        kind = field[5:].upper()
        if kind not in EDGE_WEIGHTS:
            raise QueryError(f"{kind!r} is no kind of edge", at)
        if not 1 <= len(value) <= 1000:
            raise QueryError("a value has 1 to 1000 characters", value_at)
        return Predicate("edge_target", op, value, kind)
    raise QueryError(f"{name!r} is no field", at)


def parse(source: str) -> Query:
    return _Parser(source).query()


def predicates(node: object) -> list[Predicate]:
    """The distinct predicates, as first met."""
    if isinstance(node, Predicate):
        return [node]
    parts = (node.inner,) if isinstance(node, Not) else node.parts
    return list(dict.fromkeys(p for x in parts for p in predicates(x)))


def _scalar(c: Column, op: str, value: str) -> Column:
    c, v = F.lower(F.coalesce(c, F.lit(""))), value.lower()
    held = c == v if op in ("=", "!=") else F.instr(c, v) > 0
    return ~held if op in ("!=", "!~") else held


def _date(c: Column, op: str, value: str) -> Column:
    c = F.coalesce(c, F.lit(""))
    if len(value) == 10:
        day_after = (dt.date.fromisoformat(value) + dt.timedelta(days=1)).isoformat()
        held = {"=": lambda: F.substring(c, 1, 10) == value, "!=": lambda: F.substring(c, 1, 10) != value, "<=": lambda: c < day_after, ">": lambda: c >= day_after}
        if op in held:
            return held[op]()
    return {"=": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def compile_predicate(p: Predicate, columns: dict[str, Column], flags: dict[Predicate, Column]) -> Column:
    if p in flags:
        held = flags[p]
        return ~held if p.op in ("!=", "!~") else held
    c = columns[p.field]
    if p.field == "tag":
        v = p.value.lower()
        inside = F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.coalesce((F.lower(t) == v) if p.op in ("=", "!=") else F.instr(F.lower(t), v) > 0, F.lit(False)))
        return ~inside if p.op in ("!=", "!~") else inside
    return _date(c, p.op, p.value) if p.field in _DATE else _scalar(c, p.op, p.value)


def compile_where(node: object, columns: dict[str, Column], flags: dict[Predicate, Column]) -> Column:
    if isinstance(node, Predicate):
        return compile_predicate(node, columns, flags)
    if isinstance(node, Not):
        return ~compile_where(node.inner, columns, flags)
    out = None
    for part in node.parts:
        c = compile_where(part, columns, flags)
        out = c if out is None else (out & c if isinstance(node, And) else out | c)
    return out


def execute(
    source: str | Query,
    documents: DataFrame,
    names: dict[str, str] | None = None,
    edge_owner: DataFrame | None = None,
    node_text: DataFrame | None = None,
    health: DataFrame | None = None,
    id_col: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(all matching documents, the ordered and limited ones).

    ``names`` maps fields to columns.  ``edge_owner``: document_id, kind, to_id;
    ``node_text``: id, text; ``health``: document_id, state.  Every distinct
    predicate on edges or health becomes one flag by a join with distinct ids.
    """
    q = parse(source) if isinstance(source, str) else source
    default = {"type": "type", "trust": "trust_tier", "status": "status", "path": "path", "title": "title", "tag": "tags", "updated": "updated_at", "indexed": "indexed_at"}
    names = default | (names or {})
    df, flags = documents, {}
    for i, p in enumerate(predicates(q.where)):
        if p.field == "health":
            found = health.where(F.col("state") == p.value).select(F.col("document_id"))
        elif p.field == "edge":
            found = edge_owner.where(F.col("kind") == p.edge).select("document_id")
        elif p.field == "edge_target":
            plus = Predicate("path", "~" if p.op in ("~", "!~") else "=", p.value)
            texts = node_text.where(_scalar(F.col("text"), plus.op, p.value)).select(F.col("id").alias("to_id")).distinct()
            found = edge_owner.where(F.col("kind") == p.edge).join(texts, "to_id", "left_semi").select("document_id")
        else:
            continue
        name = f"__flag{i}"
        ids = found.distinct().withColumn(name, F.lit(True))
        df = df.join(ids, df[id_col] == ids["document_id"], "left").drop("document_id")
        flags[p] = F.coalesce(F.col(name), F.lit(False))
    columns = {k: F.col(v) for k, v in names.items() if v in documents.columns}
    hits = df.where(compile_where(q.where, columns, flags)).select(*documents.columns)
    order = [columns[f].desc() if down else columns[f].asc() for f, down in q.order]
    return hits, hits.orderBy(*order, columns["path"].asc()).limit(q.limit)
