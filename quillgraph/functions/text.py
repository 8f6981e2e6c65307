"""Text primitives: trimming, slugs, search tokens, n-grams, token estimates."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s   -     　﻿]"
_HAN = "一-鿿"
_WORDS = regex.compile(r"[\p{L}\p{N}_]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+")
_RESERVED = {"and", "or", "not", "near"}
#: Raw tokens of a query that are looked at.
QUERY_TOKENS = 24


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def slugify(c: Column) -> Column:
    """Heading to anchor: ASCII letters, digits and Han, joined by single hyphens."""
    s = F.regexp_replace(F.lower(trim(c)), "`", "")
    s = F.regexp_replace(s, f"[^a-z0-9{_HAN}\\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def slugify_py(s: str) -> str:
    s = re.sub(f"[^a-z0-9{_HAN}\\s-]", "", s.strip().lower().replace("`", ""))
    return re.sub("^-|-$", "", re.sub("-+", "-", re.sub(r"\s+", "-", s))) or "section"


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("int")


def cjk_grams(run: str) -> list[str]:
    """Bigrams, then trigrams, of a run; a single character gives none."""
    return [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]


def search_tokens(text: str) -> list[str]:
    """Raw tokens of a query or of a text to embed, repeats kept.

    CJK runs give their n-grams; other parts are split at underscores.  A
    token without CJK characters yields its parts twice, as the published
    ranking does, which matters for the cap and for term weights.
    """
    out: list[str] = []
    for token in _WORDS.findall(text.lower()):
        grams = [g for run in _CJK.findall(token) for g in cjk_grams(run)]
        parts = [p for rest in _CJK.split(token) for p in rest.split("_") if p]
        out += grams + parts
        if not grams:
            out += [p for p in token.split("_") if p]
    return [t for t in out if len(t) > 1 and t not in _RESERVED]


def query_prefixes(text: str) -> list[str]:
    """The distinct prefixes that a full-text query looks for, from its first tokens."""
    return list(dict.fromkeys(search_tokens(text)[:QUERY_TOKENS]))


WORD, INDEXED = r"[\p{L}\p{N}]", r"[\p{L}\p{N}\p{Co}]"
_IDEOGRAPHS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}"
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīłńňōőřśşšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegilnnoorsssttuuuzzz"[:54])


#: Where a text has none of these, its index tokens are its words, folded one by one: the letter that folding drops, and all that lies where CJK and private letters do.
_SPECIAL = r"[\x{1100}-\x{11ff}\x{2e80}-\x{10ffff}]"


def lowered(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(lowered(c), F.lit(f"{WORD}+"), F.lit(0))


def fold(low: Column) -> Column:
    """Diacritics folded, of lower-case text."""
    return F.translate(low, *_ACCENTS)


def folded(c: Column) -> Column:
    """Lower case, diacritics folded."""
    return fold(lowered(c))


def is_simple(c: Column) -> Column:
    """Whether the index tokens are the words, each of them folded."""
    text, dropped = F.coalesce(c, F.lit("")), _ACCENTS[0][len(_ACCENTS[1]) :]
    return ~(text.rlike(_SPECIAL) | F.greatest(F.lit(False), F.lit(False), *[text.contains(x) for x in dropped + dropped.upper()]))


def grams(c: Column) -> Column:
    """CJK bigrams, then trigrams; runs are looked for only in texts with a letter from where those scripts lie."""
    none = F.array().cast("array<string>")
    run = F.when(c.rlike(_SPECIAL), F.regexp_extract_all(c, F.lit(_IDEOGRAPHS), F.lit(0))).otherwise(none)

    def of(runs: Column, n: int) -> Column:
        return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))).otherwise(none)))

    return F.flatten(F.transform(F.array(run), lambda runs: F.concat(of(runs, 2), of(runs, 3))))  # an array of one, so that the runs are found once


def index_tokens(c: Column) -> Column:
    """Tokens that the inverted index holds: words, diacritics folded, then CJK n-grams."""
    return F.concat(F.regexp_extract_all(folded(c), F.lit(f"{INDEXED}+"), F.lit(0)), grams(c))


def count_words(c: Column) -> Column:
    """The size of ``words``; of letters, only the dotted capital I becomes something else in lower case."""
    text = F.coalesce(c, F.lit(""))
    return F.regexp_count(F.when(text.contains("\u0130"), F.lower(text)).otherwise(text), F.lit(f"{WORD}+"))


def count_index_tokens(c: Column) -> Column:
    return F.when(is_simple(c), count_words(c)).otherwise(F.regexp_count(folded(c), F.lit(f"{INDEXED}+")) + F.size(grams(c)))


def _at_start(prefix: str, letters: str) -> str:
    """Matches at each token of ``letters`` that begins with the prefix; only a class with a letter of two code units looks behind by whole letters."""
    quoted = "".join(x if x.isascii() and x.isalnum() else f"\\x{{{ord(x):x}}}" for x in prefix)
    return f"(?<!{letters[:-1]}\U00010400])(?={letters}{{{max(1, len(prefix))}}}){quoted}"


def count_prefix(c: Column, prefix: str) -> Column:
    """How many of ``words`` begin with the prefix; the text is scanned only where it holds it."""
    low = lowered(c)
    return F.when(low.contains(prefix), F.regexp_count(low, F.lit(_at_start(prefix, WORD)))).otherwise(0)


def has_prefix(c: Column, prefix: str) -> Column:
    """Whether one of ``index_tokens`` begins with the prefix."""
    fold = folded(c)
    word = F.when(fold.contains(prefix), fold.rlike(_at_start(prefix, INDEXED))).otherwise(False)
    gram = F.when(F.coalesce(c, F.lit("")).contains(prefix), F.exists(grams(c), lambda t: t.startswith(prefix))).otherwise(False)
    return word | gram if not prefix.isascii() or not prefix else word
