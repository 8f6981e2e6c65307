"""Main-content extraction: the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Words score positive, tags negative;
a linear scan finds the contiguous run with the greatest sum, and the words in
it are the content.  The weights are log-odds learned from labelled pages:
how often a tag or a word (by the tag it is directly under) lies in the content.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, others, quoted

#: Bound on the labelled pages that weights are learned from.
MAX_LABELLED = 2_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z][^<>]*>|[^<\s]+|<", re.S | re.I
)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
#: Tags after which a new line of text begins.
_BLOCK = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article blockquote pre header footer nav aside main body".split())


def tokenize(page: str) -> list[tuple[str, str]]:
    """("w", word) and ("t", tag name, with / for a closing one); comments, scripts, styles and titles are one tag each."""
    out = []
    for m in _TOKEN.finditer(page):
        s = m.group(0)
        if s[0] != "<" or s == "<":
            out.append(("w", s))
        elif s.startswith("<!--"):
            out.append(("t", "!--"))
        elif m.group(1):
            out.append(("t", m.group(1).lower()))
        else:
            name = _NAME.match(s)
            out.append(("t", ("/" if s[1] == "/" else "") + name.group(1).lower()) if name else ("t", "!"))
    return out


@dataclass(frozen=True)
class ContentModel:
    """words: weight of a word by the tag last seen; tags: weight of a tag.  Always positive and negative."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -3.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum; the first and shortest of equals; (0, 0) without a positive score."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12:
            best, at = total, (start, i + 1)
    return at


def score_tokens(tokens: list[tuple[str, str]], model: ContentModel) -> list[float]:
    last, out = "", []
    for kind, s in tokens:
        if kind == "w":
            out.append(model.words.get(last, model.word))
        else:
            last = s
            out.append(model.tags.get(s, model.tag))
    return out


def extract(page: str | None, model: ContentModel) -> str | None:
    """The text of the best run, a line for each block."""
    if page is None:
        return None
    tokens = tokenize(page)
    a, b = best_run(score_tokens(tokens, model))
    lines: list[list[str]] = [[]]
    for kind, s in tokens[a:b]:
        if kind == "w":
            lines[-1].append(s)
        elif s.lstrip("/") in _BLOCK and lines[-1]:
            lines.append([])
    return _html.unescape("\n".join(" ".join(x) for x in lines if x))


def label_tokens(tokens: list[tuple[str, str]]) -> np.ndarray | None:
    """Which tokens lie in the page's one marked article; None where it has none."""
    opened = [i for i, t in enumerate(tokens) if t == ("t", "article")]
    closed = [i for i, t in enumerate(tokens) if t == ("t", "/article")]
    if len(opened) != 1 or len(closed) != 1 or opened[0] > closed[0]:
        return None
    inside = np.zeros(len(tokens), bool)
    inside[opened[0] + 1 : closed[0]] = True
    return inside


def learn(pages: list[str]) -> ContentModel:
    """Weights from pages whose content is marked by one <article>; others are passed over.

    The weight of a tag is minus a constant scaled by how seldom it is content,
    that of a word is a constant scaled by how often words after its tag are.
    The marking tag itself is not learned.
    """
    words: dict[str, list[int]] = {}
    tags: dict[str, list[int]] = {}
    for page in pages:
        tokens = tokenize(page)
        inside = label_tokens(tokens)
        if inside is None:
            continue
        last = ""
        for (kind, s), content in zip(tokens, inside):
            if kind == "w":
                words.setdefault(last, [0, 0])[int(content)] += 1
            else:
                last = s
                if s.lstrip("/") != "article":
                    tags.setdefault(s, [0, 0])[int(content)] += 1
    odds = lambda c: math.log((c[1] + 0.5) / (c[0] + 0.5))
    clamp = lambda v, a, b: min(max(v, a), b)
    return ContentModel(
        {k: round(clamp(0.5 + odds(c) / 6, 0.05, 2.0), 6) for k, c in words.items() if k.lstrip("/") != "article"},
        {k: round(clamp(-2.0 + odds(c), -12.0, -0.2), 6) for k, c in tags.items()},
    )


def train(pages: DataFrame, html_col: str = "html", max_rows: int = MAX_LABELLED) -> ContentModel:
    """Weights from at most ``max_rows`` marked pages, the first by a hash of the row.

    Rows over the share of hashes that is wanted are left out where they are
    read, so that little more than the sample is sent to the driver.  Without
    marked pages, words score 1 and tags -3.
    """
    page = F.col(quoted(html_col))
    h = F.xxhash64(*[F.col(quoted(c)) for c in pages.columns])
    marked = pages.where(page.contains("<article")).select(page.alias("html"), h.alias("h"))
    share = min(1.0, 1.2 * max_rows / max(1, marked.count()))
    few = marked.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = few.orderBy("h", "html").limit(max_rows).toPandas()
    return learn(list(sample["html"]))


def extract_content(pages: DataFrame, model: ContentModel, html_col: str = "html", out: str = "content") -> DataFrame:
    """``pages`` with the content's text.

    A null page gives null, an empty one or one without words ''.  Pages are
    read whole, in one linear scan; broken markup is read as words.  Equal
    pages give equal text; a column named like the output is replaced, all
    others are untouched.  No rows give none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some tag names

    @lean
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([extract(p, shared.value) for p in column], dtype=object)

    (tmp,) = fresh(pages, "content")
    df = pages.withColumn(tmp, F.pandas_udf(extracted, "string")(F.col(quoted(html_col))))
    return df.select(*others(pages, out), F.col(tmp).alias(out))


def op10_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, content of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_content(pages, train(pages)).select("page_id", "url", "content")
