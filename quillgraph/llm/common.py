"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``; where that
    is unset, one machine makes a local folder and a cluster is refused.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if conf is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="quillgraph-checkpoint-")
    sc.setCheckpointDir(conf)
    return conf


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that clash with none of ``df``, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *outputs: str) -> list[Column]:
    """The columns of ``df``, without those that an output of the same name replaces."""
    taken = {x.lower() for x in outputs}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in taken]


def objects(values: Iterable) -> pd.Series:
    """A column of texts or lists that keeps its kind when it has no rows."""
    return pd.Series(list(values), dtype=object)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text in joins."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled), F.xxhash64(F.lit(0x5BD1E995), filled, F.length(filled))]


def fits(df: DataFrame, size: Column, most: int) -> bool:
    """Whether all rows of ``df``, each of ``size`` bytes and some more, take at most ``most`` bytes."""
    return (df.agg(F.sum(F.coalesce(size, F.lit(0)) + 48)).first()[0] or 0) <= most


#: Rows of a batch that is sent to Python; texts are long, so the default of Spark would be many times a worker's own memory.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python in batches of at most ``BATCH_ROWS``, for this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving memory back to the system at its end: workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
