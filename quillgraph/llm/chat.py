"""Chat formatting: conversations to token ids and loss masks.

Segments are encoded apart and reserved ids are spliced between them, so no
text can make a reserved id: control strings that occur in content are
escaped before it is encoded.  A turn is

    <begin> role newline content <end>

and the mask is 1 on the content and the end of assistant turns.  It comes
from the segments' lengths: their prefix sums are the places where each
begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import TOKENIZER, load_encoding

#: Reserved ids, free in the 50k vocabulary (ids 0 to 50255).
BEGIN, END, STOP = 50257, 50258, 50256
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
ROLES = ("system", "user", "assistant", "tool")
#: Whose turns are learned.
LEARNED = "assistant"
#: Role of a turn whose own is null, empty or unknown.
DEFAULT_ROLE = "user"


def escape(text: str) -> str:
    """Control strings get a backslash behind their first character; so do escaped ones, which keeps it reversible."""
    return re.sub(r"<(\\*\|(?:im_start|im_end|endoftext|system|user|assistant)\|>)", r"<\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*\|(?:im_start|im_end|endoftext|system|user|assistant)\|>)", r"<\1", text)


def role_of(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in ROLES else DEFAULT_ROLE


def assemble(turns: list[tuple[str | None, str | None]], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, loss mask, begin of each turn) of one conversation."""
    segments: list[list[int]] = []
    learned: list[int] = []
    for role, text in turns:
        name = role_of(role)
        body = encode(escape(text or ""))
        mine = int(name == LEARNED)
        segments += [[BEGIN], encode(name + "\n"), body, [END]]
        learned += [0, 0, mine, mine]
    segments.append([STOP])
    learned.append(0)
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths)
    ids = np.fromiter((i for s in segments for i in s), np.int32, int(ends[-1]))
    # +1 where a learned segment begins, -1 where it ends; the running sum is the mask
    step = np.zeros(len(ids) + 1, np.int32)
    np.add.at(step, ends - lengths, learned)
    np.add.at(step, ends, -np.array(learned))
    starts = (ends - lengths)[:-1:4].astype(np.int32)
    return ids, np.cumsum(step[:-1]).astype(np.int8), starts


def format_chats(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, n_turns, input_ids, loss_mask, turn_starts: a row for each conversation.

    Turns are ordered by turn (nulls last), then role and text; repeated rows
    are turns of their own.  A null or unknown role counts as ``user``, a null
    text as empty.  Turns with a null conv_id make one conversation of null
    id.  Texts are encoded whole.  Other columns are ignored.
    """
    turns = df.select("conv_id", F.struct(F.col("turn").isNull().alias("none"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(tokenizer).encode_ordinary
        for roles, texts in batches:
            rows = [assemble(list(zip(r, t)), encode) for r, t in zip(roles, texts)]
            yield pd.DataFrame({"ids": [r[0] for r in rows], "mask": [r[1] for r in rows], "starts": [r[2] for r in rows]})

    made = F.pandas_udf(build, "ids array<int>, mask array<tinyint>, starts array<int>")
    out = chats.select("conv_id", F.size("roles").alias("n_turns"), made("roles", "texts").alias("c"))
    return out.select("conv_id", "n_turns", F.col("c.ids").alias("input_ids"), F.col("c.mask").alias("loss_mask"), F.col("c.starts").alias("turn_starts"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
