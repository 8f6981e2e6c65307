"""Full-text search: postings and BM25 over prefix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_index_tokens, count_prefix, count_words, fold, has_prefix, index_tokens, is_simple, words

K1, B = 1.2, 0.75
POSTINGS_SCHEMA = "term string, id string, indexed bigint, plain bigint, len int"
TOTALS_SCHEMA = "n_all bigint, avg_len double"


def bm25(docs: DataFrame, id_col: str, text_col: str, prefixes: list[str], indexed: bool = False) -> DataFrame:
    """id, score of the texts that hold a token with one of ``prefixes``.

    A phrase is a prefix; its weight is ln((N - n + .5) / (n + .5)), 1e-6 where
    that is not positive.  Scores are positive, greater is better.  Prefixes
    are counted where a text holds them, without making its tokens, and only
    texts that match are measured a second time; ids and counts are shuffled.
    ``indexed``: match and measure the indexed stream, with CJK n-grams, while
    term frequencies come from the words alone.
    """
    if not prefixes:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    text = F.col(text_col)
    tf = [count_prefix(text, p) for p in prefixes]
    hit = [has_prefix(text, p) if indexed else n > 0 for n, p in zip(tf, prefixes)]
    length = count_index_tokens(text) if indexed else count_words(text)
    rows = docs.select(F.col(id_col).alias("id"), length.alias("len"), *[n.alias(f"tf{i}") for i, n in enumerate(tf)], *[h.alias(f"hit{i}") for i, h in enumerate(hit)])
    totals = rows.agg(F.count(F.lit(1)).alias("n_all"), F.avg("len").alias("avg_len"), *[F.sum(F.col(f"hit{i}").cast("bigint")).alias(f"n{i}") for i in range(len(prefixes))])
    return _scored(rows, totals, len(prefixes))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, indexed, plain, len: the inverted index.

    How often the term stands in the indexed stream and among the plain words
    of the text, and the length of the stream.
    """
    text, t, kind = F.col(text_col), F.col("t"), F.col("kind")
    rows = docs.select(F.col(id_col).alias("id"), words(text).alias("plain"), F.when(~is_simple(text), index_tokens(text)).alias("stream"))
    part = lambda kind, tokens: F.struct(F.lit(kind).alias("kind"), F.col(tokens).alias("tokens"))
    parts = F.when(F.col("stream").isNull(), F.array(part("both", "plain"))).otherwise(F.array(part("stream", "stream"), part("plain", "plain")))
    tokens = rows.select("id", F.size(F.coalesce("stream", "plain")).alias("len"), F.inline(parts)).select("id", "len", "kind", F.explode("tokens").alias("t"))
    tokens = tokens.withColumn("f", F.when((kind == "both") & (F.length(t) < F.octet_length(t)), fold(t)).otherwise(t))
    row = lambda term, i, p: F.struct(F.col(term).alias("term"), F.lit(i).alias("i"), F.lit(p).alias("p"))
    given = F.when(kind == "stream", F.array(row("t", 1, 0))).when(kind == "plain", F.array(row("t", 0, 1))).when(F.col("f") == t, F.array(row("t", 1, 1))).otherwise(F.array(row("f", 1, 0), row("t", 0, 1)))
    both = tokens.select("id", "len", F.inline(given))
    return both.groupBy("term", "id").agg(F.sum("i").alias("indexed"), F.sum("p").alias("plain"), F.first("len").alias("len"))


def totals(docs: DataFrame, text_col: str) -> DataFrame:
    """n_all, avg_len: one row about all texts."""
    return docs.agg(F.count(F.lit(1)).alias("n_all"), F.avg(count_index_tokens(F.col(text_col))).alias("avg_len"))


def term_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, tf, df: how often a word comes and in how many ids.

    Where no id comes twice, both are counted by terms alone, which are few;
    else pairs of a term and an id have to be told apart.  Texts without an id
    count for ``tf``.
    """
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("t"))
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        once = F.when(F.col("id").isNotNull(), F.array_distinct("t")).otherwise(F.slice("t", 1, 0))
        per = rows.select(F.posexplode(F.array("t", once)).alias("k", "t")).select("k", F.explode("t").alias("term"))
        return per.groupBy("term").agg(F.sum((F.col("k") == 0).cast("bigint")).alias("tf"), F.sum(F.col("k").cast("bigint")).alias("df"))
    per = rows.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("id").alias("df"))


def bm25_postings(stored: DataFrame, about: DataFrame, prefixes: list[str]) -> DataFrame:
    """What ``bm25`` gives with ``indexed``, from ``postings`` and ``totals``: only rows of the prefixes are read."""
    if not prefixes:
        return stored.select("id", F.lit(0.0).alias("score")).limit(0)
    term = F.col("term")
    wanted = term.startswith(prefixes[0])
    for p in prefixes[1:]:
        wanted = wanted | term.startswith(p)
    cols = []
    for i, p in enumerate(prefixes):
        cols += [F.sum(F.when(term.startswith(p), F.col("plain")).otherwise(0)).alias(f"tf{i}"), F.max(term.startswith(p) & (F.col("indexed") > 0)).alias(f"hit{i}")]
    rows = stored.where(wanted).groupBy("id").agg(F.first("len").alias("len"), *cols)
    return _scored(rows, rows.agg(*[F.sum(F.col(f"hit{i}").cast("bigint")).alias(f"n{i}") for i in range(len(prefixes))]).crossJoin(about), len(prefixes))


def _scored(rows: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """id, score of ``rows`` (id, len, tf0, hit0, ...) by ``totals`` (n_all, avg_len, n0, ...), one row."""
    joined = rows.where(F.greatest(*[F.col(f"hit{i}") for i in range(n)], F.lit(False))).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(n):
        raw = F.log((F.col("n_all") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.select("id", score.alias("score"))
