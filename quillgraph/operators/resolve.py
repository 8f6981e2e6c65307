"""References to documents and sections, resolved by joins on aliases and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify, trim
from ..session import few


def posix(c: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\./", "")


def alias_key(c: Column) -> Column:
    """How a reference or an alias is compared: no Markdown extension, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(trim(posix(c)), r"^\./", ""), r"(?i)\.mdx?$", ""))


def joined_path(folder: Column, path: Column) -> Column:
    """``path`` from ``folder`` with ``.`` and ``..`` worked out."""
    parts = F.split(F.concat_ws("/", folder, path), "/")
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(last(acc), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def document_aliases(parsed: DataFrame) -> DataFrame:
    """alias, target: what names exactly one document: its path, stem, front-matter id or title."""
    names = F.array("path", F.element_at(F.split("path", "/"), -1), F.col("front.id"), F.col("title"))
    rows = parsed.select(F.col("id").alias("target"), F.explode(F.array_distinct(F.transform(F.array_compact(names), alias_key))).alias("alias"))
    return unique_aliases(rows.where("alias <> ''"))


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """alias, target for the aliases (alias, target) of a single target; the others resolve to nothing."""
    return aliases.groupBy("alias").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).where("n = 1").drop("n")


def section_anchors(parsed: DataFrame) -> DataFrame:
    """target, anchor, section: own anchors before slugs of headings; of several the last own, the first slug."""
    s = parsed.select(F.col("id").alias("target"), F.posexplode("sections").alias("i", "s"))
    own = s.select("target", F.col("s.anchor").alias("anchor"), F.lit(0).alias("kind"), (-F.col("i")).alias("at"), F.col("s.id").alias("section"))
    slugs = s.select("target", slugify(F.col("s.heading")), F.lit(1), F.col("i"), F.col("s.id"))
    return own.union(slugs).groupBy("target", "anchor").agg(F.min(F.struct("kind", "at", "section")).alias("m")).select("target", "anchor", F.col("m.section").alias("section"))


def resolve(references: DataFrame, parsed: DataFrame) -> DataFrame:
    """``references`` (from_id, from_path, ref, anchor, ...) with node_id and target_id, null where nothing is meant.

    ``anchor`` null: none was given.  A reference with an anchor that its
    document lacks resolves to nothing; so does a name of two documents.
    """
    reference = posix(F.col("ref"))
    relative = reference.rlike(r"^\.?\.?/") | reference.rlike(r"(?i)\.mdx?(?:#|$)")
    plain = alias_key(reference)
    folder = F.regexp_replace("from_path", "[^/]*$", "")
    key = F.when(relative & (plain != ""), alias_key(joined_path(folder, reference))).otherwise(plain)
    anchored = F.coalesce(F.col("anchor"), F.lit("")) != ""
    keyed = references.withColumn("__key", key).withColumn("__slug", F.when(anchored, slugify(F.col("anchor"))))
    found = keyed.join(document_aliases(parsed).select(F.col("alias").alias("__key"), F.col("target").alias("__target")), "__key", "left")
    target = F.when(F.col("__key") != "", F.col("__target")).when(anchored, F.col("from_id"))
    found = found.withColumn("__target", target)
    anchors = section_anchors(parsed).select(F.col("target").alias("__target"), F.col("anchor").alias("__slug"), F.col("section").alias("__section"))
    both = found.join(anchors, ["__target", "__slug"], "left")
    node = F.when(anchored, F.col("__section")).otherwise(F.col("__target"))
    return both.withColumn("node_id", node).withColumn("target_id", F.when(node.isNotNull(), F.col("__target"))).drop("__key", "__slug", "__target", "__section")


def split_anchor(c: Column) -> tuple[Column, Column]:
    """(reference, anchor) at the first ``#``."""
    at = F.instr(c, "#")
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.nullif(F.substring(c, at + 1, F.length(c)), F.lit("")))


def is_external(url: Column) -> Column:
    return url.rlike("(?i)^(?:https?:|mailto:)")


def is_local_document(url: Column) -> Column:
    """Links that a dead one of is worth a warning."""
    return ~url.rlike("(?i)^(?:https?:|mailto:|#)") & url.rlike(r"(?i)(?:\.mdx?|#)")


def markdown_links(parsed: DataFrame) -> DataFrame:
    """from_id, from_path, ref, anchor, raw, line, section_id, kind of the links that stay in the project."""
    rows = parsed.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), F.posexplode("links").alias("i", "l"))
    parts = F.split(F.col("l.url"), "#", -1)
    rows = rows.where(~is_external(F.col("l.url"))).select(
        "from_id", "from_path", "i", F.get(parts, F.lit(0)).alias("ref"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("anchor"),
        F.col("l.url").alias("raw"), "l.line", "l.section_id", F.lit("markdown").alias("kind"),
    )
    return rows


def wiki_links(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), F.posexplode("wiki_links").alias("i", "l"))
    return rows.select("from_id", "from_path", "i", F.col("l.target").alias("ref"), "l.anchor", "l.raw", "l.line", "l.section_id", F.lit("wikilink").alias("kind"))


def all_links(parsed: DataFrame) -> DataFrame:
    """Every link of either kind, resolved."""
    return resolve(markdown_links(parsed).union(wiki_links(parsed)), parsed)


def front_references(parsed: DataFrame, names: list[str]) -> DataFrame:
    """from_id, from_path, field, i, raw, ref, anchor, resolved, of the references in the front matter."""

    def field(n: str) -> Column:
        return F.transform(F.col(f"front.{n}"), lambda v, i: F.struct(F.lit(n).alias("field"), i.alias("i"), v.alias("raw")))

    kinds = [field(n) for n in names]
    rows = parsed.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), F.inline(F.concat(*kinds)))
    ref, anchor = split_anchor(F.col("raw"))
    return resolve(rows.withColumn("ref", ref).withColumn("anchor", anchor), parsed)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_by_rare(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As ``first_by``, for wide rows whose keys seldom come twice: only rows of such keys are sent and sorted."""
    twice = df.groupBy(*keys).count().where("count > 1").drop("count")
    if twice.isEmpty():
        return df
    twice = few(twice)
    alone = df.join(twice, keys, "left_anti").select(*df.columns)
    return alone.where(~_null(keys)).union(first_by(df.join(twice, keys, "left_semi").select(*df.columns).union(df.where(_null(keys))), keys, order))


def _null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out
