"""Packing documents into training windows: bounded-space online best fit.

A document's tokens, ended by an end-of-text token, are cut into full windows
and a rest.  Rests come online: each partition keeps at most ``OPEN`` windows
open, places a rest into the open window that it fits best, and where none
fits emits the fullest to open a new one.  Windows left open at the end of a
partition are merged in rounds, again by best fit, until one partition is
left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import lean, materialize, objects, quoted, small_batches

WINDOW = 2048
OPEN = 16
#: Documents of one partition, and leftover partitions merged in one round.
PARTITION_DOCS, FAN_IN = 20_000, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of the public 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = "struct<doc_id:string,start:int,length:int>"
_OPEN_SCHEMA = f"part long, window string, used int, done boolean, pieces array<{_PIECE}>"


def load_encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Numbers of tokens of whole texts; the encoder is faster on them than a cache of their words."""

    def __init__(self, encoding):
        self.encode = encoding.encode_ordinary

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def token_counts(docs: DataFrame, text_col: str, tokenizer: str):
    @lean
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(load_encoding(tokenizer))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return F.pandas_udf(counts, "long")(F.col(quoted(text_col)))


class Packer:
    """Bounded-space best fit: at most ``space`` open windows."""

    def __init__(self, size: int, space: int):
        self.size, self.space = size, space
        self.open: list[tuple[int, list]] = []  # used, pieces

    def add(self, length: int, pieces: list) -> tuple[int, list] | None:
        """Places pieces of ``length`` tokens in all; returns a window that had to go."""
        if length == self.size:  # a window of its own
            return length, list(pieces)
        best = -1
        for i, (used, _) in enumerate(self.open):
            if used + length <= self.size and (best < 0 or used > self.open[best][0]):
                best = i
        if best >= 0:
            used, held = self.open[best]
            self.open[best] = (used + length, held + pieces)
            return self.open.pop(best) if used + length == self.size else None
        out = None
        if len(self.open) >= self.space:
            full = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            out = self.open.pop(full)
        self.open.append((length, list(pieces)))
        return out


def _rows(part: int, windows: list[tuple[int, list, bool]], prefix: str) -> pd.DataFrame:
    return pd.DataFrame({
        "part": np.full(len(windows), part, np.int64),
        "window": objects(f"{prefix}-{part}-{i}" for i in range(len(windows))),
        "used": np.array([w[0] for w in windows], np.int32),
        "done": np.array([w[2] for w in windows], bool),
        "pieces": objects(w[1] for w in windows),
    })


def _first(size: int, space: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], na_position="last", kind="stable")
        packer, done = Packer(size, space), []
        for doc, n in zip(pdf["doc_id"], pdf["n"]):
            n, at = int(n), 0
            while n - at >= size:
                done.append((size, [{"doc_id": doc, "start": at, "length": size}], True))
                at += size
            if n > at and (gone := packer.add(n - at, [{"doc_id": doc, "start": at, "length": n - at}])):
                done.append((*gone, True))
        return _rows(int(key[0]), done + [(*w, False) for w in packer.open], "p")

    return pack


def _next(size: int, space: int, level: int, last: bool):
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, done = Packer(size, space), []
        for used, pieces in zip(*(pdf.sort_values(["part", "window"], kind="stable")[c] for c in ("used", "pieces"))):
            held = [dict(p) if isinstance(p, dict) else p.asDict() for p in pieces]
            if gone := packer.add(int(used), held):
                done.append((*gone, True))
        return _rows(int(key[0]), done + [(*w, last) for w in packer.open], f"m{level}")

    return merge


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, space: int = OPEN, tokenizer: str = TOKENIZER, partition_docs: int = PARTITION_DOCS) -> DataFrame:
    """window_id, used, doc_ids, starts, lengths: the windows.

    ``starts`` and ``lengths`` count tokens of the document, its end-of-text
    token included; every token of every document is in exactly one window and
    none holds more than ``window``.  Null and empty texts have no tokens and
    are in none; an id may be of any type that casts to a string and back, and a
    null one stays null; repeated rows are packed each.  Which
    partition a document goes to depends on its id and text alone, so the
    windows don't depend on how the input is split.  No rows give no windows.
    """
    small_batches(docs.sparkSession)
    text = F.col(quoted(text_col))
    n = token_counts(docs, text_col, tokenizer)
    sizes = docs.select(F.col(quoted(id_col)).cast("string").alias("doc_id"), F.xxhash64(F.col(quoted(id_col)), text).alias("h"), n.alias("n"))
    sizes = materialize(sizes.where("n > 0").select("doc_id", "h", (F.col("n") + 1).alias("n")))
    parts = max(1, -(-sizes.count() // partition_docs))
    packed = sizes.withColumn("part", F.pmod("h", F.lit(parts))).groupBy("part").applyInPandas(_first(window, space), _OPEN_SCHEMA)
    packed = materialize(packed)
    out, level = packed.where("done"), 0
    left = packed.where("NOT done")
    while True:
        level, parts = level + 1, -(-parts // FAN_IN)
        merged = left.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("to").applyInPandas(_next(window, space, level, parts == 1), _OPEN_SCHEMA)
        merged = materialize(merged)
        out = out.union(merged.where("done"))
        if parts == 1:
            break
        left = merged.where("NOT done")
    return out.select(
        F.col("window").alias("window_id"), "used",
        F.col("pieces.doc_id").cast(ArrayType(docs.schema[id_col].dataType)).alias("doc_ids"), F.col("pieces.start").alias("starts"), F.col("pieces.length").alias("lengths"),
    )


def window_tokens(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_of_text: int | None = None) -> DataFrame:
    """window_id, tokens: the token ids of windows that ``pack`` made of ``docs``.

    Texts are encoded once, where they are, and only the pieces are sent on.
    ``end_of_text``: the id that ends a document, by default that after the
    vocabulary's.  Ids must be distinct: of rows with one id, the pieces
    couldn't be told apart; null ids are left out.
    """
    pieces = windows.select("window_id", F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("at", "p"))
    wanted = pieces.select(F.col("p.doc_ids").alias("id"), F.struct("window_id", "at", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length")).alias("piece"))
    wanted = wanted.groupBy("id").agg(F.collect_list("piece").alias("pieces"))

    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(tokenizer)
        last = encoding.n_vocab if end_of_text is None else end_of_text
        for pdf in batches:
            window, at, tokens = [], [], []
            for text, held in zip(pdf["text"], pdf["pieces"]):
                ids = np.array([*encoding.encode_ordinary(text), last], np.int32)
                for p in held:
                    window.append(p["window_id"]), at.append(p["at"]), tokens.append(ids[p["start"] : p["start"] + p["length"]])
            yield pd.DataFrame({"window_id": objects(window), "at": np.array(at, np.int32), "tokens": objects(tokens)})

    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(wanted, "id").select("text", "pieces")
    parts = texts.mapInPandas(cut, "window_id string, at int, tokens array<int>")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])
    return parts.groupBy("window_id").agg(F.flatten(ordered).alias("tokens"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
