"""Markdown files as a DataFrame: listing, exclusion, parsing."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.markdown import PARSED_SCHEMA, parse_document
from ..model import EXCLUDED, Config
from ..session import lean, small_batches


def glob_regex(pattern: str) -> str:
    """A glob (``**``, ``*``, ``?``, ``[...]``, ``{a,b}``) as an anchored regular expression."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out.append("[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def ignore_globs(text: str) -> list[str]:
    """Globs of the subset of ignore files that counts: no negations, slash-less names at any depth."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        rooted = line.startswith("/")
        line = line.lstrip("/")
        own = [line + "**"] if line.endswith("/") else [line, line + "/**"]
        out += own
        if not rooted and "/" not in line.rstrip("/"):
            out += ["**/" + g for g in own]
    return out


def exclude_globs(config: Config, ignore_text: str = "") -> list[str]:
    """Built-in excludes always apply; those of the settings and the ignore file add to them."""
    built_in = [g for name in EXCLUDED for g in (f"{name}/**", f"**/{name}/**")]
    return built_in + list(config.exclude) + (ignore_globs(ignore_text) if config.follow_gitignore else [])


def _ignore_text(root: str) -> str:
    path = os.path.join(root, ".gitignore")
    if "://" not in root and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return ""


def list_files(spark: SparkSession, root: str, config: Config | None = None, ignore_text: str | None = None) -> DataFrame:
    """path (relative), modified, length, content of the Markdown files under ``root``.

    Paths, extensions and sizes are filtered before contents are read on; dot
    files and links are left out.  Works on any file system that Spark reads.
    """
    config = config or Config()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx,MD,MDX,Md,Mdx}").load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root if "://" in root or root.startswith("file:") else os.path.abspath(root)).rstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z0-9]+:/*", "/"), f"^{re.escape(base)}/", "")
    return narrowed(files.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length", "content"), config, _ignore_text(root) if ignore_text is None else ignore_text)


def narrowed(files: DataFrame, config: Config, ignore_text: str = "") -> DataFrame:
    """The files (path, length and others) that the settings include."""
    extension = r"(?i)\.mdx?$" if config.parse_mdx else r"(?i)\.md$"
    kept = files.where(F.col("path").rlike(extension) & (F.col("length") <= config.max_file_bytes) & ~F.col("path").rlike(r"(^|/)\."))
    if config.include:
        kept = kept.where(F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in config.include)))
    excluded = exclude_globs(config, ignore_text)
    return kept.where(~F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in excluded)))


#: Files whose records are held at once.
SLICE = 100


def _record(path: str, stamp: str, content: bytes) -> dict:
    try:
        raw = bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content
        return parse_document(path, raw, stamp)
    except Exception as e:  # noqa: BLE001  one bad file must not fail the others
        return {"path": path, "error": f"{type(e).__name__}: {e}"}


def _stored(records: list[dict], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(records, kind)
    except (pa.ArrowException, ValueError, TypeError, OverflowError) as e:
        if len(records) > 1:
            return pa.concat_arrays([_stored([r], kind) for r in records])
        return pa.array([{"path": records[0]["path"], "error": f"{type(e).__name__}: {e}"}], kind)


def _parser(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.struct(list(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_struct_array(_stored([_record(*row) for row in zip(*(c.to_pylist() for c in part.columns))], kind))

    return lean(parse)


def parse_files(files: DataFrame) -> DataFrame:
    """A nested record for each file; ``error`` says why one could not be parsed, its other columns are null."""
    stamp = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    small_batches(files.sparkSession)
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], PARSED_SCHEMA).schema)
    return files.select("path", stamp.alias("updated_at"), "content").mapInArrow(_parser(schema), PARSED_SCHEMA)
