"""Personal data: information-theoretic sanitisation.

Protected entities (addresses, numbers, secrets) are found by shape and
replaced by their class.  That alone doesn't hide them: a term that stands
beside an entity in the corpus and hardly elsewhere gives it away.  So corpus
co-occurrence is counted, and with N texts the disclosure of entity e by term t
is

    PMI(e, t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

1 when t occurs only with e.  In texts that hold e, terms at or over
``REMOVE`` are removed, those at or over ``GENERALISE`` become their class.

Counted like this are entities and the parts that several share (the domain
of an address, a network, the first digits of a number) with the terms that
stand beside them in at least ``MIN_JOINT`` texts.  Most entities are in fewer
texts, which tells little: there n(t) is raised by ``PRIOR``, only terms that
look like names or handles (a capital, a digit, an underscore) are judged, and
they become their class but aren't removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, fresh, lean, materialize, objects, others, quoted, small_batches, text_key

#: Disclosure from which terms are generalised and removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Words on each side of an entity whose co-occurrence is counted; texts that must share a pair; shortest term.
CONTEXT, MIN_JOINT, MIN_TERM = 6, 3, 3
#: Texts that a term is taken to stand in besides, where an entity is in fewer than MIN_JOINT.
PRIOR = 1
#: Bytes up to which terms, or keys of repeated texts, are broadcast; more are joined by shuffling.
BROADCAST_BYTES = 96_000_000

_SHAPES = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "KEY": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{20,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]+",
    "SECRET": r"(?i:(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[ ]?[=:][ ]?)(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"',;]{4,})",
    "IBAN": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IP": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d)",
    "SSN": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "CARD": r"\d(?:[ \-]?\d){12,18}(?!\d)",
    "PHONE": r"\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d|\.\d)|\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|\d{2,4}[.\-]\d{3,4}[.\-]\d{3,4}(?!\d)",
    "HASH": r"[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
}
_ENTITY = re.compile(r"(?<![A-Za-z0-9._%+@\-])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _SHAPES.items()) + ")")
_WORD = re.compile(r"[^\W_](?:[\w'’]*[^\W_])?")
#: What lies between words, in Java's notation; and what a word doesn't begin or end with.
_JAVA_GAP, _EDGE = r"[_'’]*[^\p{L}\p{N}_'’]+[_'’]*", "_'’"


def corpus_words(text: Column) -> Column:
    """The distinct words of ``_WORD`` in the text in lower case; some may be empty."""
    return F.array_distinct(F.split(F.trim(F.lower(text), F.lit(_EDGE)), _JAVA_GAP))


def may_hold(text: Column) -> Column:
    """False for texts that hold no entity: no digit, key, mark or long hash."""
    keys = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ")
    out = text.rlike("[0-9@=:]")
    for k in keys:
        out = out | text.contains(k)
    return out | text.rlike("[a-fA-F]{32}") | text.rlike(r"\p{Nd}")


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the entities, the longest at each place by the order of the classes."""
    return [(m.start(), m.end(), m.lastgroup) for m in _ENTITY.finditer(text)]


def entity_keys(kind: str, text: str) -> list[str]:
    """The entity and its part that others share, as counted."""
    text = text.lower()
    out = [f"{kind}:{text}"]
    if kind == "EMAIL":
        out.append(f"EMAIL@{text.rpartition('@')[2]}")
    elif kind == "IP":
        out.append(f"IP/{text.rpartition('.')[0]}")
    elif kind in ("PHONE", "CARD"):
        out.append(f"{kind}/{''.join(c for c in text if c.isdigit())[:6]}")
    return out


def named(word: str) -> bool:
    """Whether a word looks like a name or a handle."""
    return word[0].isupper() or "_" in word or any(c.isdigit() for c in word)


def terms_near(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, dict[str, bool]]]:
    """(entity or part, terms within CONTEXT words of it and whether they look like names); entities are not terms."""
    plain, end = [], 0
    for a, b, _ in spans:
        plain += [text[end:a], " " * (b - a)]
        end = b
    words = [(m.start(), m.group(0)) for m in _WORD.finditer("".join(plain) + text[end:])] if spans else []
    starts = np.array([w[0] for w in words], np.int64)
    out = []
    for a, b, kind in spans:
        i, j = np.searchsorted(starts, a), np.searchsorted(starts, b)
        near: dict[str, bool] = {}
        for _, w in words[max(0, i - CONTEXT) : i] + words[j : j + CONTEXT]:
            for t in _WORD.findall(w.lower()):  # itself, but for letters that are several in lower case
                if len(t) >= MIN_TERM:
                    near[t] = near.get(t, False) or named(w)
        out += [(key, near) for key in entity_keys(kind, text[a:b])]
    return out


@lean
def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        k1, k2, entity, term, name = [], [], [], [], []
        for a, b, text in zip(pdf["k1"], pdf["k2"], pdf["text"]):
            seen: dict[str, dict[str, bool]] = {}
            for e, near in terms_near(text, find_entities(text)):
                held = seen.setdefault(e, {})
                for t, x in near.items():
                    held[t] = held.get(t, False) or x
            for e, near in seen.items():
                for t, x in (near or {"": False}).items():
                    k1.append(a), k2.append(b), entity.append(e), term.append(t), name.append(x)
        yield pd.DataFrame({
            "k1": np.array(k1, np.int64), "k2": np.array(k2, np.int64), "entity": objects(entity), "term": objects(term), "named": np.array(name, bool),
        })


def revealing_terms(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) at or over GENERALISE, and (k1, k2, entity) of all texts with entities.

    All texts are counted, each distinct one once; the words of the whole
    corpus are only joined with the terms that are judged.  Parts of entities
    are among the entities.
    """
    text = F.col(quoted(text_col))
    k1, k2 = text_key(text)
    maybe = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).where(may_hold(text))
    # a text that repeats gives the same rows again, so distinct() counts it once
    pairs = materialize(maybe.mapInPandas(_scan, "k1 long, k2 long, entity string, term string, named boolean").distinct())
    holders = pairs.select("k1", "k2", "entity").distinct()
    n_e = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    joint = pairs.where("term <> ''").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.max("named").alias("named")).join(n_e, "entity")
    rare = F.col("entity").rlike("^[A-Z]+:") & (F.col("n_e") < MIN_JOINT) & F.col("named")
    joint = materialize(joint.withColumn("rare", rare).where(F.col("rare") | (F.col("n_et") >= MIN_JOINT)).drop("named"))
    wanted = joint.select("term").distinct()
    wanted = F.broadcast(wanted) if fits(joint, F.octet_length("term"), BROADCAST_BYTES) else wanted
    # a row of a text that stands in m rows weighs 1 / m, so words need only be added up where they are read
    copies = materialize(docs.where(text != "").groupBy(k1.alias("a"), k2.alias("b")).agg(F.count(F.lit(1)).alias("m")))
    total = copies.agg(F.count(F.lit(1)).alias("n_all"))
    again = copies.where("m > 1")
    again = F.broadcast(again) if fits(again, F.lit(24), BROADCAST_BYTES) else again
    rows = docs.where(text != "").select(k1.alias("a"), k2.alias("b"), text.alias("text")).join(again, ["a", "b"], "left")
    words = rows.select(F.coalesce(1.0 / F.col("m"), F.lit(1.0)).alias("w"), F.explode(corpus_words(F.col("text"))).alias("term"))
    n_t = words.join(wanted, "term", "left_semi").groupBy("term").agg(F.round(F.sum("w")).cast("long").alias("n_t"))
    scored = joint.join(n_t, "term", "left").crossJoin(F.broadcast(total))  # one row
    n_all = F.greatest(F.col("n_all"), F.col("n_e"))
    n_term = F.greatest(F.coalesce(F.col("n_t"), F.col("n_et")), F.col("n_et")) + F.when(F.col("rare"), PRIOR).otherwise(0)
    ic = F.log(n_all / F.col("n_e"))
    pmi = F.log(n_all * F.col("n_et") / (F.col("n_e") * n_term))
    disclosure = F.when(ic > 0, F.round(pmi / ic, 6)).otherwise(F.lit(0.0))
    disclosure = F.when(F.col("rare"), F.least(disclosure, F.lit(REMOVE - 1e-6))).otherwise(disclosure)
    out = scored.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return out, holders


def generalise(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitise(text: str, removed: set[str], generalised: set[str]) -> tuple[str, int, int]:
    """The text with entities by class and revealing terms generalised or removed; how many of each."""
    spans = find_entities(text)
    parts, end, changed = [], 0, 0

    def plain(s: str) -> str:
        nonlocal changed
        if not removed and not generalised:
            return s

        def swap(m: re.Match) -> str:
            nonlocal changed
            w = m.group(0)
            low = w.lower()
            if low in removed:
                changed += 1
                return ""
            if low in generalised:
                changed += 1
                return generalise(w)
            return w

        return _WORD.sub(swap, s)

    for a, b, kind in spans:
        parts += [plain(text[end:a]), f"[{kind}]"]
        end = b
    parts.append(plain(text[end:]))
    return "".join(parts), len(spans), changed


def sanitise_documents(docs: DataFrame, text_col: str = "text", out: tuple[str, str, str] = ("clean", "entities", "terms")) -> DataFrame:
    """``docs`` with the sanitised text and the numbers of entities and terms replaced.

    Null and empty texts stay as they are; texts without entities are not
    touched; repeated rows are treated alike and count once; on an empty
    table nothing is revealing.  Columns named like an output are replaced,
    all others are untouched.
    """
    small_batches(docs.sparkSession)
    terms, holders = revealing_terms(docs, text_col)
    by_text = (
        holders.join(terms, "entity").groupBy("k1", "k2")
        .agg(
            F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("removed"),
            F.collect_set(F.when(F.col("disclosure") < REMOVE, F.col("term"))).alias("generalised"),
        )
    )
    by_text = materialize(by_text)
    text = F.col(quoted(text_col))
    a, b, n1, n2, x, y, tmp = fresh(docs, "k1", "k2", "t1", "t2", "removed", "generalised", "pii")
    k1, k2 = text_key(text)
    by_text = by_text.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("removed").alias(x), F.col("generalised").alias(y))
    terms_of = F.octet_length(F.array_join(F.concat(x, y), " "))
    by_text = F.broadcast(by_text) if fits(by_text, terms_of, BROADCAST_BYTES) else by_text
    df = docs.withColumns({a: k1, b: k2}).join(by_text, (F.col(a) == F.col(n1)) & (F.col(b) == F.col(n2)), "left")

    @lean
    def clean(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, removed, generalised in batches:
            rows = []
            for t, r, g in zip(texts, removed, generalised):
                new, n, m = sanitise(t, set(r) if r is not None else set(), set(g) if g is not None else set()) if t else (None, 0, 0)
                rows.append((new if n else None, n, m))
            yield pd.DataFrame({"text": [r[0] for r in rows], "entities": [r[1] for r in rows], "terms": [r[2] for r in rows]})

    # texts that can hold no entity don't go to Python
    made = F.pandas_udf(clean, "text string, entities int, terms int")(F.when(may_hold(text), text), F.col(x), F.col(y))
    hit = F.col(tmp)
    return df.withColumn(tmp, made).select(
        *others(docs, *out),
        F.coalesce(hit["text"], text).alias(out[0]), hit["entities"].alias(out[1]), hit["terms"].alias(out[2]),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, clean, entities, terms of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sanitise_documents(docs).select("doc_id", "clean", "entities", "terms")
