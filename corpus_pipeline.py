"""From raw documents to training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  Between stages, ``run`` writes Parquet
under the folder of ``spark.checkpoint.dir`` and reads it again, so a lost
executor costs at most one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import ensure_checkpoint_dir, read_table
from quillgraph.llm.decontaminate import remove_leaks
from quillgraph.llm.lines import dedup_lines
from quillgraph.llm.packing import pack
from quillgraph.llm.simhash import drop_near_duplicates
from quillgraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents found toxic go; the rest are unchanged.

    Null and empty texts stay, equal texts share their fate, ids may be null or repeat.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: recurring lines are cut from the texts; every document stays.

    Null and empty texts stay as they are; repeated rows are cut alike and count once.
    """
    return dedup_lines(docs, dropped=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the smallest doc_id stays.

    Null ids come after all others; of repeated rows one stays; null, empty and blank texts are one group.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of the benchmark are cut; documents made of them go.

    Null and empty texts stay; null and empty test items count for nothing.
    """
    return remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: windows of at most 2048 tokens over all that is left.

    Null and empty texts are in none; null ids stay null; repeated rows are packed each.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained decoding, templates, SimHash and the automaton are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows made of the documents of ``sf_dir``."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
