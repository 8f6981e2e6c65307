"""Entities of parsed documents, by regular expressions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..model import Config
from .resolve import first_by

_L, _K = r"\p{L}\p{N}", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # word ends among ASCII characters only
_UBEFORE, _UAFTER = rf"(?<![{_L}_])", rf"(?![{_L}_])"
_VERB = "(?:" + "|".join(("GET", "POST", "PUT", "PATCH", "DELETE")) + ")"
_PATH = rf"/[{_L}_./:{{}}-]+"
ROUTE = rf"{_BEFORE}{_VERB}\s+{_PATH}|(?<![{_L}_@.:/-]){_PATH}"
ERROR = rf"{_BEFORE}(?:[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{{3,}}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*){_AFTER}"
_DOTTED = r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,}"
_CJK_KEY = rf"[{_K}]+(?:[._][{_K}]+)+"
PROSE_KEY = rf"{_UBEFORE}(?:[A-Z][A-Z0-9]*_[A-Z0-9_]+|[A-Z](?=[A-Z0-9_]{{2,}}{_UAFTER})[A-Z0-9_]*\d[A-Z0-9_]*|{_DOTTED}|{_CJK_KEY}){_UAFTER}"
_KEY = rf"[A-Z][A-Z0-9_]{{2,}}|{_DOTTED}|{_CJK_KEY}"
CODE_KEY = rf"{_UBEFORE}(?:{_KEY}){_UAFTER}"
# no anchor behind the extension: the first of the list that fits ends the path
_EXTENSIONS = "ts tsx js jsx md mdx json yaml yml toml rs go py java cs sql"
FILE = rf"(?:^|\s)([{_L}_@.-]+/[{_L}_@./-]+\.(?:{'|'.join(_EXTENSIONS.split())}))"
_TOOLS = "(?:" + "|".join("npm pnpm yarn go cargo docker kubectl node npx".split()) + ")"
COMMAND = rf"{_BEFORE}{_TOOLS}\s+[^\n`]+"
_NAME = r"[\p{L}_$][\p{L}\p{N}\p{M}_$]*"
CALL = rf"(?<![{_L}_$]){_NAME}(?:\.{_NAME})?\(\)"
DECLARED = rf"{_BEFORE}(?:class|interface|type|enum|namespace|module)\s+({_NAME})"
USED = rf"{_BEFORE}(?:new|extends|implements|instanceof)\s+({_NAME})"
_LATIN = r"^[A-Z][A-Za-z0-9]+(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?$"
_CJK = rf"^[{_K}][{_K}\p{{N}}_-]{{1,63}}$"
_WHOLE_ROUTE = rf"^(?:{_VERB}\s+)?{_PATH}$"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _keys(text: Column, pattern: str) -> Column:
    return F.filter(found(text, pattern), lambda k: ~k.rlike(f"^{_VERB}$"))


def clean(name: Column) -> Column:
    """Without a backtick at either end and one mark at the end."""
    return F.regexp_replace(F.regexp_replace(trim(name), "^`|`$", ""), "[.,;:]$", "")


def normal(name: Column) -> Column:
    return F.lower(F.regexp_replace(trim(name), "^`|`$", ""))


def kind_of(name: Column) -> Column:
    n = trim(name)
    return (
        F.when(n.rlike(_WHOLE_ROUTE), "api_route")
        .when(F.concat(F.lit(" "), n).rlike(FILE), "file_path")
        .when(n.rlike(rf"^{_TOOLS}\s+"), "command")
        .when(n.rlike(ERROR), "error_code")
        .when(n.rlike(f"^(?:{_KEY})$"), "config_key")
        .when(n.rlike(r"^@?[a-z0-9_.-]+/[a-z0-9_.-]+$"), "package")
        .when(n.rlike(r"(?i)^ADR-?\d+$"), "decision")
        .otherwise("symbol")
    )


def looks_like_entity(text: Column) -> Column:
    c = clean(text)
    return (c != "") & (c.rlike(_WHOLE_ROUTE) | c.rlike(_LATIN) | c.rlike(f"^(?:{_KEY})$") | c.rlike(rf"^{_NAME}(?:\.{_NAME})?\(\)$"))


def structured(text: Column, source: str) -> Column:
    parts = [found(text, ROUTE), found(text, ERROR), _keys(text, CODE_KEY), found(text, COMMAND), found(text, CALL), found(text, FILE, 1)]
    if source == "inline":
        c = clean(text)
        parts.append(F.when(c.rlike(_LATIN) | c.rlike(_CJK), F.array(c)).otherwise(F.array().cast("array<string>")))
    if source == "code":
        parts += [found(text, DECLARED, 1), found(text, USED, 1)]
    return F.concat(*parts)


def extract_entities(parsed: DataFrame, config: Config | None = None) -> DataFrame:
    """document_id, path, section_id, name, normal, kind, role, provenance, confidence, seq.

    Eight projections, each of which reads one nested column, in the order
    that decides which of equal entities of a section stays: the first.
    """
    config = config or Config()
    doc = [F.col("id").alias("document_id"), "path"]

    def rows(df: DataFrame, section: Column, names: Column, order: list[Column], role: str, provenance: str, confidence: float, exempt: bool) -> DataFrame:
        exploded = df.select("document_id", "path", section.alias("section_id"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.posexplode(names).alias("o3", "name"))
        return exploded.select(
            "document_id", "path", "section_id", clean(F.col("name")).alias("name"), F.struct("o0", "o1", "o2", "o3").alias("seq"),
            F.lit(role).alias("role"), F.lit(provenance).alias("provenance"), F.lit(confidence).alias("confidence"), F.lit(exempt).alias("exempt"),
        )

    none, zero = F.lit(None).cast("string"), F.lit(0)
    front = parsed.select(*doc, F.col("front.defines").alias("names"))
    sections = parsed.select(*doc, F.posexplode("sections").alias("i", "s"))
    listed = F.concat(found(F.col("s.content"), r"[-*]\s+`([^`]+)`", 1), found(F.col("s.content"), rf"(?m)^[-*]\s+([{_L}_.:/-]+)\s*:", 1))
    prose = F.concat(found(F.col("s.content"), ROUTE), found(F.col("s.content"), ERROR), _keys(F.col("s.content"), PROSE_KEY))
    defining = sections.where(trim(F.col("s.heading")).rlike("(?i)^(?:defines?|definitions?|定义)$"))
    inline = parsed.select(*doc, F.posexplode("inline_code").alias("i", "s"))
    code = parsed.select(*doc, F.posexplode("code_blocks").alias("i", "s"))
    links = parsed.select(*doc, F.posexplode("links").alias("i", "s"))
    wiki = parsed.select(*doc, F.posexplode("wiki_links").alias("i", "s"))
    label = F.coalesce(F.col("s.alias"), F.col("s.target"))
    at = lambda stage, step=0: [F.lit(stage), F.col("i"), F.lit(step)]
    own, placed = F.col("s.id"), F.col("s.section_id")
    everything = (
        rows(front, none, F.col("names"), [zero, zero, zero], "definition", "frontmatter", 1.0, True)
        .union(rows(defining, own, listed, at(1), "definition", "declared_section", 0.85, True))
        .union(rows(sections.where(looks_like_entity(F.col("s.heading"))), own, F.array("s.heading"), at(1, 1), "definition", "heading", 0.8, True))
        .union(rows(sections, own, prose, at(1, 2), "reference", "regex", 0.6, False))
        .union(rows(inline, placed, structured(F.col("s.value"), "inline"), at(2), "reference", "inline_code", 0.75, False))
        .union(rows(code, placed, structured(F.col("s.value"), "code"), at(3), "reference", "code_block", 0.7, False))
        .union(rows(links, placed, structured(F.concat_ws(" ", "s.text", "s.url"), "link"), at(4), "reference", "markdown_link", 0.7, False))
        .union(rows(wiki.where(looks_like_entity(label)), placed, F.array(label), at(5), "reference", "wikilink", 0.7, False))
    )
    named = everything.where("name <> ''").withColumn("kind", kind_of(F.col("name"))).withColumn("normal", normal(F.col("name")))
    stop = [s.strip().strip("`").lower() for s in config.stop_entities]
    if stop:
        named = named.where(F.col("exempt") | ~F.col("normal").isin(stop))
    whose = F.coalesce("section_id", F.lit("doc"))
    first = first_by(named.withColumn("__s", whose), ["document_id", "role", "kind", "normal", "__s", "provenance"], [F.col("seq")])
    return first.where(F.col("kind").isin(list(config.enabled_kinds))).drop("__s", "exempt")


def content_risks(docs: DataFrame, id_col: str = "path", text_col: str = "body") -> DataFrame:
    """id, line, reason: up to four rows for each line of a text."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")).alias("i", "t"))
    t = F.col("t")
    low = F.lower(t)
    reasons = {
        "possible prompt injection text": low.contains("ignore previous instructions") | low.contains("system prompt"),
        "HTML script or iframe": t.rlike(rf"(?i)<\s*(?:script|iframe){_AFTER}"),
        "active data URI": t.rlike("(?i)data:(?:text/html|application/javascript)"),
        "hidden Unicode format character": t.rlike(r"\p{Cf}"),
    }
    given = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()]))
    return lines.select("id", (F.col("i") + 1).alias("line"), F.explode(given).alias("reason"))
