"""Markdown to nested records: front matter, sections, links and code.

A line scanner finds the blocks (ATX and setext headings, fenced and indented
code, HTML blocks, paragraphs, list items, quotes) and a character scanner the
inline parts (code spans, inline links, autolinks, bare URLs).  Links by
reference and images are recognised only so as not to be taken for others.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml

from ..model import DOCUMENT_KINDS, TRUST_TIERS
from .ids import content_hash, stable_id_py
from .text import slugify_py

MAX_NODES, MAX_DEPTH = 10_000, 256
LIST_FIELDS = ("tags", "defines", "depends_on", "implements", "supersedes", "deprecated_by", "source_refs")
TEXT_FIELDS = ("id", "title", "status")


# --------------------------------------------------------------- front matter
class _Loader(yaml.SafeLoader):
    """YAML 1.2 core types: yes, no, dates and sexagesimals stay text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^[-+]?[0-9]+$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


_IMPLICIT = re.compile("|".join(f"(?:{r.pattern})" for rs in {k: [x[1] for x in v] for k, v in _Loader.yaml_implicit_resolvers.items()}.values() for r in rs))
_LETTERS = "A-Za-z0-9À-ÖØ-öø-ɏ一-鿿"
_SCALAR = rf"[{_LETTERS}./](?:[{_LETTERS}_./ -]{{0,300}}[{_LETTERS}_./-])?"
_ENTRY = re.compile(rf"([A-Za-z_][A-Za-z0-9_-]{{0,99}}): +(?:({_SCALAR})|\[ *({_SCALAR}(?:, *{_SCALAR})*) *\]) *\r?")


def _plain_mapping(lines: list[str]) -> dict | None:
    """What YAML gives for lines that are all ``key: words`` or ``key: [words, words]``, with no word for a number, a truth or null; else None."""
    out: dict = {}
    for s in lines:
        m = _ENTRY.fullmatch(s)
        if m is None:
            return None
        items = [m[2]] if m[2] is not None else [x.strip(" ") for x in m[3].split(",")]
        if any(_IMPLICIT.match(x) for x in (m[1], *items)):
            return None
        out[m[1]] = m[2] if m[2] is not None else items
    return out


@dataclass
class FrontMatter:
    data: dict
    body: str
    offset: int  # lines before the body
    diagnostics: list[dict]


def _diagnostic(code: str, message: str, line: int) -> dict:
    return {"code": f"front_matter.{code}", "message": message, "line": line}


def _text(value: object) -> str | None:
    return (value.strip() or None) if isinstance(value, str) else None


def _texts(value: object) -> list[str]:
    given = value if isinstance(value, list) else [value]
    return [x.strip() for x in given if isinstance(x, str) and x.strip()]


def _one_of(value: object, known: frozenset[str]) -> str | None:
    low = value.strip().lower() if isinstance(value, str) else None
    return low if low in known else None


def split_front_matter(raw: str) -> FrontMatter:
    """The YAML block between two lines of three hyphens, if the text begins with one."""
    text = raw.removeprefix("﻿")
    lines = text.split("\n")
    fence = lambda s: re.fullmatch(r"---[ \t]*", s.removesuffix("\r")) is not None
    if not fence(lines[0]):
        return FrontMatter({}, text, 0, [])
    close = next((i for i, s in enumerate(lines[1:], 1) if fence(s)), None)
    if close is None:
        return FrontMatter({}, text, 0, [_diagnostic("unclosed", "The front matter is opened but never closed.", 1)])
    block, body = "\n".join(lines[1:close]), "\n".join(lines[close + 1 :])
    found: list[dict] = []
    data: object = {}
    if block.strip() and (data := _plain_mapping(lines[1:close])) is None:
        data = {}
        try:
            data = yaml.load(block, Loader=_Loader)  # noqa: S506  a safe loader
        except yaml.YAMLError as e:
            data, found = {}, [_diagnostic("invalid_yaml", " ".join(str(e).split()), 2)]
        if not isinstance(data, dict):
            data, found = {}, [_diagnostic("not_mapping", "The front matter must be a mapping.", 2)]
    at: dict[str, int] = {}
    for i, s in enumerate(lines[1:close], 2):
        if m := re.match(r"([A-Za-z0-9_-]+)\s*:", s):
            at.setdefault(m[1], i)

    def wrong(name: str, wanted: str) -> None:
        found.append(_diagnostic("invalid_field", f"{name} must be a {wanted}, not {type(data[name]).__name__}.", at.get(name, 2)))

    for name in TEXT_FIELDS:
        if name in data and not _text(data[name]):
            wrong(name, "text that isn't empty")
    for name, known in (("type", DOCUMENT_KINDS), ("trust_tier", TRUST_TIERS)):
        if name in data and not _one_of(data[name], known):
            wrong(name, f"known {name}")
    for name in LIST_FIELDS:
        if name in data and not (isinstance(data[name], str) or (isinstance(data[name], list) and all(isinstance(x, str) for x in data[name]))):
            wrong(name, "text or list of texts")
    return FrontMatter(data, body, close + 1, found)


def normalise(data: dict) -> dict:
    out: dict = {k: _text(data.get(k)) for k in TEXT_FIELDS}
    out |= {"type": _one_of(data.get("type"), DOCUMENT_KINDS), "trust_tier": _one_of(data.get("trust_tier"), TRUST_TIERS)}
    return out | {k: _texts(data.get(k)) for k in LIST_FIELDS}


# --------------------------------------------------------------------- inline
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>", re.S)
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]+|[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", re.I)
_MAY_LINK, _ORDINARY = re.compile(r"@|://|www\.", re.I), re.compile(r"[^\\`<\[!*_~]+")
_DESTINATION = re.compile(r"\s*(?:<((?:\\.|[^<>\n\\])*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\]|\([^\s()]*\))*\))*))")
_TITLE = re.compile(r"""\s+(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|\(((?:\\.|[^()\\])*)\))""", re.S)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


@dataclass
class Inline:
    """Plain text, links (text, url, title, offset) and code spans (value, start, end) of a block."""

    text: str = ""
    links: list[tuple[str, str, str | None, int]] = field(default_factory=list)
    spans: list[tuple[str, int, int]] = field(default_factory=list)


def _label_end(s: str, i: int) -> int:
    """Index of the bracket that closes the one at i, or -1."""
    depth = 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 1
        elif c == "`":
            run = len(s) - i - len(s[i:].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(s, i + run)
            i = close.end() - 1 if close else i + run - 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _target(s: str, i: int) -> tuple[str, str | None, int] | None:
    """(url, title, end) of a destination in parentheses that opens at i."""
    m = _DESTINATION.match(s, i + 1)
    end, title = m.end(), None
    if t := _TITLE.match(s, end):
        title, end = _ESCAPE.sub(r"\1", next(x for x in t.groups() if x is not None)), t.end()
    while end < len(s) and s[end].isspace():
        end += 1
    if end >= len(s) or s[end] != ")":
        return None
    return _ESCAPE.sub(r"\1", m[1] if m[1] is not None else m[2] or ""), title, end + 1


def scan_inline(s: str, links: bool = True, base: int = 0, nesting: int = 0) -> Inline:
    if nesting > MAX_DEPTH:
        raise ValueError(f"the text nests deeper than {MAX_DEPTH}")
    out, i, plain = Inline(), 0, []
    ordinary = None if links and _MAY_LINK.search(s) else _ORDINARY  # without bare links, only marks matter
    while i < len(s):
        if ordinary and (m := ordinary.match(s, i)):
            plain.append(m[0])
            i = m.end()
            continue
        c = s[i]
        if c == "\\" and i + 1 < len(s) and _ESCAPE.match(s, i):
            plain.append(s[i + 1])
            i += 2
        elif c == "`":
            run = len(s) - i - len(s[i:].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(s, i + run)
            if close is None:
                plain.append(s[i : i + run])
                i += run
                continue
            value = s[i + run : close.start()].replace("\n", " ")
            if value[:1] == " " == value[-1:] and value.strip(" "):
                value = value[1:-1]
            out.spans.append((value, base + i, base + close.end()))
            plain.append(value)
            i = close.end()
        elif c == "<" and (m := _AUTOLINK.match(s, i)):
            if links:
                out.links.append((m[1], m[1] if ":" in m[1] else f"mailto:{m[1]}", None, base + i))
            plain.append(m[1])
            i = m.end()
        elif c == "<" and (m := _TAG.match(s, i)):
            plain.append(m[0])
            i = m.end()
        elif c == "[" or (c == "!" and s[i + 1 : i + 2] == "["):
            image = c == "!"
            start = i + image
            end = _label_end(s, start)
            to = _target(s, end + 1) if end >= 0 and s[end + 1 : end + 2] == "(" else None
            if to is None:
                plain.append(s[i : start + 1])
                i = start + 1
                continue
            inner = scan_inline(s[start + 1 : end], links=image and links, base=base + start + 1, nesting=nesting + 1)
            if not image:
                out.spans += inner.spans
                plain.append(inner.text)
                if links and to[0]:
                    out.links.append((inner.text.strip(), to[0], to[1], base + i))
            i = to[2]
        elif links and (c in "hHwW" or c.isalnum()) and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] in "/_.+-@")) and (m := _BARE.match(s, i)):
            url = m[0].rstrip("?!.,:*_~'\"")
            while url.endswith(")") and url.count(")") > url.count("("):
                url = url[:-1].rstrip("?!.,:*_~'\"")
            mail = not re.match(r"(?:https?://|www\.)", url, re.I)
            out.links.append((url, f"mailto:{url}" if mail else url if ":" in url[:6] else f"http://{url}", None, base + i))
            plain.append(url)
            i += len(url)
        else:
            if c not in "*_~":
                plain.append(c)
            elif c == "_" and 0 < i < len(s) - 1 and s[i - 1].isalnum() and s[i + 1].isalnum():
                plain.append(c)
            elif c in "*~" and (i + 1 >= len(s) or s[i + 1].isspace()) and (i == 0 or s[i - 1].isspace()):
                plain.append(c)
            i += 1
    out.text = "".join(plain)
    return out


# --------------------------------------------------------------------- blocks
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"([ \t]*)(`{3,}|~{3,})([^\n]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}(?:<(script|pre|style|textarea)\b|(<!--)|</?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dd|dt|fieldset|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)\b)", re.I)
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")


@dataclass
class Blocks:
    headings: list[tuple[int, int, str]] = field(default_factory=list)  # line, level, text
    code: list[tuple[int, int, str | None, str]] = field(default_factory=list)  # first line, last line, language, text
    links: list[tuple[str, str, str | None, int]] = field(default_factory=list)
    spans: list[tuple[str, int, int, int, int]] = field(default_factory=list)  # value, line and column of start and end


def scan_blocks(lines: list[str]) -> Blocks:
    """Lines count from 1, columns from 1."""
    out = Blocks()
    paragraph: list[tuple[int, int, str]] = []  # line, column offset, text
    nodes = 0

    def inline(parts: list[tuple[int, int, str]]) -> Inline:
        nonlocal nodes
        found = scan_inline("\n".join(p[2] for p in parts))
        ends, total = [], 0
        for p in parts:
            total += len(p[2]) + 1
            ends.append(total)

        def place(at: int) -> tuple[int, int]:
            k = next(k for k, e in enumerate(ends) if at < e)
            return parts[k][0], parts[k][1] + at - (ends[k - 1] if k else 0) + 1

        out.links.extend((t, u, title, place(at)[0]) for t, u, title, at in found.links)
        out.spans.extend((v, *place(a), *place(b)) for v, a, b in found.spans)
        nodes += 1 + 2 * (len(found.links) + len(found.spans))
        if nodes > MAX_NODES:
            raise ValueError(f"the text holds over {MAX_NODES} nodes")
        return found

    def close() -> None:
        if paragraph:
            inline(paragraph)
            paragraph.clear()

    i, in_list, list_indent = 0, False, 0
    while i < len(lines):
        raw = lines[i].replace("\t", "    ") if lines[i][:1] == "\t" else lines[i]
        line, shift = raw, 0
        quoted = 0
        while m := _QUOTE.match(line):
            line, shift, quoted = line[m.end() :], shift + m.end(), quoted + 1
        if quoted > MAX_DEPTH:
            raise ValueError(f"the text nests deeper than {MAX_DEPTH}")
        if not line.strip():
            close()
            i += 1
            continue
        indent = len(line) - len(line.lstrip(" "))
        if in_list and not indent and not _ITEM.match(line) and not paragraph:
            in_list = False
        inner = line[min(indent, list_indent) :] if in_list else line
        fence = _FENCE.match(inner)
        if fence and len(fence[1]) < 4 and not (fence[2][0] == "`" and "`" in fence[3]):
            close()
            end, text = i + 1, []
            while end < len(lines):
                body = lines[end]
                for _ in range(quoted):
                    body = _QUOTE.sub("", body, count=1)
                if re.fullmatch(rf"[ \t]*{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*", body):
                    break
                cut = (min(indent, list_indent) if in_list else 0) + len(fence[1])
                text.append(body[min(cut, len(body) - len(body.lstrip(" "))) :])
                end += 1
            language = fence[3].strip().split()
            out.code.append((i + 1, min(end + 1, len(lines)), language[0] if language else None, "\n".join(text)))
            nodes += 1
            i = end + 1
            continue
        if not paragraph and len(inner) - len(inner.lstrip(" ")) >= 4 and not in_list:
            end, text = i, []
            while end < len(lines) and (not lines[end].strip() or lines[end].replace("\t", "    ").startswith("    ")):
                text.append(lines[end].replace("\t", "    ")[4:])
                end += 1
            while text and not text[-1].strip():
                text.pop()
                end -= 1
            out.code.append((i + 1, end, None, "\n".join(text)))
            i = end
            continue
        if not paragraph and (m := _HTML.match(inner)):
            stop = re.compile(rf"</{m[1]}>", re.I) if m[1] else re.compile("-->") if m[2] else None
            while i < len(lines) and (lines[i].strip() if stop is None else not stop.search(lines[i])):
                i += 1
            i += stop is not None
            continue
        if m := _ATX.match(inner):
            close()
            text = m[2] or ""
            found = inline([(i + 1, shift + raw[shift:].find(text) if text else shift, text)])
            out.headings.append((i + 1, len(m[1]), found.text.strip()))
            i += 1
            continue
        if paragraph and (m := _SETEXT.match(inner)) and paragraph[0][0] > 0:
            first = paragraph[0][0]
            found = inline(paragraph)
            paragraph.clear()
            out.headings.append((first, 1 if m[1][0] == "=" else 2, found.text.strip()))
            i += 1
            continue
        if _RULE.match(inner):
            close()
            i += 1
            continue
        if m := _ITEM.match(inner):
            close()
            at = (len(line) - len(inner)) + m.end()
            in_list, list_indent = True, at
            rest = line[at:]
            while m := _ITEM.match(rest):
                at, rest = at + m.end(), rest[m.end() :]
            if h := _ATX.match(rest):
                found = inline([(i + 1, shift + at, h[2] or "")])
                out.headings.append((i + 1, len(h[1]), found.text.strip()))
            elif f := _FENCE.match(rest):
                lines = lines[:i] + [" " * at + rest] + lines[i + 1 :]
                list_indent = at
                if f and not (f[2][0] == "`" and "`" in f[3]):
                    continue
            elif rest.strip():
                paragraph.append((i + 1, shift + at, rest))
            i += 1
            continue
        if not paragraph and _DEFINITION.match(inner):
            i += 1
            continue
        text = line.lstrip(" ")
        paragraph.append((i + 1, shift + len(line) - len(text), text))
        i += 1
    close()
    return out


# ------------------------------------------------------------------ documents
def _sections(doc_id: str, headings: list[tuple[int, int, str]], lines: list[str], offset: int, fallback: str) -> list[dict]:
    heads = [h for h in headings if h[1] <= 4]
    if not heads:
        return [{
            "id": stable_id_py("section", f"{doc_id}:root"), "anchor": "", "heading": fallback or "Document", "level": 1,
            "start_line": offset + 1, "end_line": offset + len(lines), "content": "\n".join(lines),
        }]
    seen: dict[str, int] = {}
    out = []
    for k, (line, level, text) in enumerate(heads):
        end = heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines)
        slug = slugify_py(text)
        seen[slug] = seen.get(slug, 0) + 1
        anchor = slug if seen[slug] == 1 else f"{slug}-{seen[slug]}"
        out.append({
            "id": stable_id_py("section", f"{doc_id}:{anchor}"), "anchor": anchor, "heading": text, "level": level,
            "start_line": line + offset, "end_line": end + offset, "content": "\n".join(lines[line - 1 : max(end, line - 1)]),
        })
    return out


_WIKI = re.compile(r"\[\[([^\]]+)\]\]")


def _wiki(lines: list[str], blocks: Blocks) -> Iterator[tuple[str, str, str | None, str | None, int]]:
    covered = {n for a, b, _, _ in blocks.code for n in range(a, b + 1)}
    for n, s in enumerate(lines, 1):
        if n in covered or "[[" not in s:
            continue
        for m in _WIKI.finditer(s):
            a, b = m.start() + 1, m.end() + 1
            if any((n > l1 or b > c1) and (n < l2 or a < c2) for _, l1, c1, l2, c2 in blocks.spans if l1 <= n <= l2):
                continue
            target, _, alias = m[1].partition("|")
            target, _, anchor = target.partition("#")
            if target.strip():
                yield m[0], target.strip(), anchor.split("#")[0].strip() or None, alias.split("|")[0].strip() or None, n


def parse_document(path: str, raw: str, updated_at: str | None = None) -> dict:
    """The record of one file; ``path`` is relative to the project, with forward slashes."""
    front = split_front_matter(raw)
    meta = normalise(front.data)
    doc_id = stable_id_py("document", meta["id"] or path.lower())
    lines = re.split(r"\r?\n", front.body)
    blocks = scan_blocks(lines)
    name = posixpath.basename(path)
    sections = _sections(doc_id, blocks.headings, lines, front.offset, meta["title"] or name)

    def section_of(line: int) -> str:
        return next((s["id"] for s in sections if s["start_line"] <= line <= s["end_line"]), sections[0]["id"])

    placed = lambda line: {"line": line + front.offset, "section_id": section_of(line + front.offset)}
    first = next((t for _, level, t in blocks.headings if level == 1), None)
    return {
        "id": doc_id, "path": path, "title": meta["title"] or first or posixpath.splitext(name)[0], "hash": content_hash(raw), "updated_at": updated_at,
        "front": meta, "diagnostics": front.diagnostics, "body": front.body, "sections": sections,
        "links": [{"text": t, "url": u, "title": title, **placed(n)} for t, u, title, n in blocks.links],
        "wiki_links": [{"raw": r, "target": t, "anchor": a, "alias": alias, **placed(n)} for r, t, a, alias, n in _wiki(lines, blocks)],
        "code_blocks": [{"language": lang, "value": v, **placed(a)} for a, _, lang, v in blocks.code],
        "inline_code": [{"value": v, **placed(n)} for v, n, _, _, _ in blocks.spans],
        "error": None,
    }


_PLACE = "line: int, section_id: string"
PARSED_SCHEMA = (
    "id string, path string, title string, hash string, updated_at string, "
    "front struct<id: string, title: string, status: string, type: string, trust_tier: string, " + ", ".join(f"{k}: array<string>" for k in LIST_FIELDS) + ">, "
    "diagnostics array<struct<code: string, message: string, line: int>>, body string, "
    "sections array<struct<id: string, anchor: string, heading: string, level: int, start_line: int, end_line: int, content: string>>, "
    f"links array<struct<text: string, url: string, title: string, {_PLACE}>>, "
    f"wiki_links array<struct<raw: string, target: string, anchor: string, alias: string, {_PLACE}>>, "
    f"code_blocks array<struct<language: string, value: string, {_PLACE}>>, inline_code array<struct<value: string, {_PLACE}>>, error string"
)
