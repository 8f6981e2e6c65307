"""URL filter: logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, others, quoted

#: Width of the hashed feature space and the n-grams used.
BUCKETS, SIZES = 1 << 18, (3, 4, 5)
#: URLs with at least this probability of being unwanted are rejected.
THRESHOLD = 0.5
#: Bound on the labelled URLs that the model is fitted to.
MAX_LABELLED = 20_000

#: The small labelled table; label 1: unwanted.  Hosts are invented, also such as hold harmless words like unwanted ones.
TABLE = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = TABLE) -> pd.DataFrame:
    """url, label of the labelled table."""
    return pd.read_csv(path, sep="\t", dtype={"url": str, "label": int}, keep_default_na=False)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host without user and port, and the path with its query; no fragment."""
    rest = (url or "").strip().lower().partition("#")[0]
    rest = rest.partition("://")[2] if "://" in rest else rest.removeprefix("//")
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return rest[:cut].rpartition("@")[2].partition(":")[0], rest[cut:]


def hashed_ngrams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram occurrence; digits count as one digit."""
    rows, buckets = [], []
    for space, pick in enumerate((0, 1)):
        parts = [("^" + host_and_path(u)[pick] + "$").encode() for u in urls]
        lengths = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        data = np.where((data >= 48) & (data <= 57), np.uint64(48), data)
        owner = np.repeat(np.arange(len(parts)), lengths)
        for n in SIZES:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, 1469598103934665603 + 31 * n + 7 * space, np.uint64)
            for k in range(n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
            whole = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][whole])
            buckets.append((h[whole] & np.uint64(BUCKETS - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, urls: list[str | None]) -> np.ndarray:
        rows, buckets = hashed_ngrams(urls)
        total = np.bincount(rows, self.weights[buckets], len(urls))
        size = np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))
        return 1 / (1 + np.exp(-(self.bias + total / size)))


def fit(table: pd.DataFrame, steps: int = 1000, rate: float = 2.0, l2: float = 1e-5) -> UrlModel:
    """Full-batch gradient descent (AdaGrad) with L2; deterministic.

    Null labels are left out; with no rows every probability is one half.
    """
    table = table[table["label"].notna()]
    urls, y = list(table["url"]), table["label"].to_numpy(float)
    w, b = np.zeros(BUCKETS), 0.0
    if not len(urls):
        return UrlModel(w.astype(np.float32), b)
    rows, buckets = hashed_ngrams(urls)
    used, local = np.unique(buckets, return_inverse=True)
    x = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))[rows]
    v, g2, b2 = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b + np.bincount(rows, v[local] * x, len(urls)))))
        r = (p - y) / len(urls)
        g = np.bincount(local, r[rows] * x, len(used)) + l2 * v
        g2 += g * g
        b2 += r.sum() ** 2
        v -= rate * g / np.sqrt(g2) * 0.1
        b -= rate * r.sum() / np.sqrt(b2) * 0.1
    w[used] = v
    return UrlModel(w.astype(np.float32), float(b))


def score_urls(df: DataFrame, model: UrlModel, url_col: str = "url", out: tuple[str, str] = ("url_score", "keep"), threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the probability of an unwanted URL and whether to keep the row.

    Null, empty and blank URLs score null and are kept: nothing is known
    against them.  Equal URLs score equal; columns named like an output are replaced,
    all others are untouched.  No rows give none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^18 floats

    @lean
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            p = shared.value.probability(list(urls)) if len(urls) else np.zeros(0)
            known = np.array([bool(u and u.strip()) for u in urls], bool)
            yield pd.Series(np.where(known, np.round(p, 6), np.nan)).astype(object).where(known, None)

    (tmp,) = fresh(df, "url_score")
    with_score = df.withColumn(tmp, F.pandas_udf(scored, "double")(F.col(quoted(url_col))))
    keep = F.coalesce(F.col(tmp) < threshold, F.lit(True))
    return with_score.select(*others(df, *out), F.col(tmp).alias(out[0]), keep.alias(out[1]))


def fit_table(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """A model from a labelled table (url, label), of which ``max_rows`` rows, the first by a hash, are used."""
    rows = labelled.select("url", "label").where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    return fit(rows.toPandas())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, url_score, keep of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return score_urls(pages, fit(labelled_urls()))
