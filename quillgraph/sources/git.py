"""Scopes and snapshots from a repository of source files."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import Config
from ..operators.health import Scope
from .markdown import narrowed


class GitError(Exception):
    pass


def _git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout


def parse_name_status(text: str) -> dict[str, list]:
    """Rows of status and paths, tabs between."""
    out: dict[str, list] = {"changed": [], "deleted": [], "renamed": []}
    for line in text.splitlines():
        status, *paths = line.split("\t")
        if not paths:
            continue
        if status[:1] == "R" and len(paths) == 2:
            out["renamed"].append(tuple(paths))
        elif status[:1] == "D":
            out["deleted"].append(paths[0])
        elif status[:1] in "AMCT":
            out["changed"].append(paths[-1])
    return out


def _markdown(path: str) -> bool:
    return path.lower().endswith((".md", ".mdx"))


def scope(root: str, base: str | None = None) -> Scope:
    """What differs from ``base``; without it, from the last commit, with untracked files."""
    spans = [[f"{base}...HEAD"]] if base else [[], ["--cached"]]
    found: dict[str, list] = {"changed": [], "deleted": [], "renamed": []}
    for span in spans:
        for k, v in parse_name_status(_git(root, "diff", "--name-status", "-M", *span, "--").decode()).items():
            found[k] += v
    untracked = [] if base else _git(root, "ls-files", "--others", "--exclude-standard").decode().splitlines()
    keep = lambda paths: tuple(sorted({p for p in paths if _markdown(p)}))
    renamed = tuple(sorted({r for r in found["renamed"] if any(map(_markdown, r))}))
    return Scope("since" if base else "changed", keep(found["changed"]), keep(found["deleted"]), renamed, keep(untracked), base)


def renames(root: str, base: str) -> dict[str, str]:
    return dict(parse_name_status(_git(root, "diff", "--name-status", "-M", base, "--").decode())["renamed"])


def revision(root: str, ref: str) -> str:
    if ref.startswith("-"):
        raise GitError("a revision can't begin with a hyphen")
    return _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def snapshot_files(spark: SparkSession, root: str, ref: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(Markdown files, paths of all files) of a revision; only Markdown is read."""
    commit = revision(root, ref)
    listed = [x.partition("\t") for x in _git(root, "ls-tree", "-r", "-z", "-l", commit).decode().split("\0") if x]
    entries = [(path, *about.split()[1:4]) for about, _, path in listed]  # path, kind, object, size
    paths = [e[0] for e in entries]
    ignore = _git(root, "show", f"{commit}:.gitignore").decode(errors="replace") if ".gitignore" in paths else ""
    rows = [(p, None, int(size), blob) for p, kind, blob, size in entries if kind == "blob" and _markdown(p)]
    files = narrowed(spark.createDataFrame(rows, "path string, modified timestamp, length long, blob string"), config or Config(), ignore)
    read = files.repartition(max(1, -(-len(rows) // 2_000))).mapInPandas(_reader(root), "path string, modified timestamp, length long, content binary")
    return read, spark.createDataFrame([(p,) for p in paths], "path string")


def _reader(root: str):
    """Contents of blobs, from one process a batch, where the executors see the repository's folder as they see its files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="".join(f"{b}\n" for b in pdf["blob"]).encode(), capture_output=True, check=True).stdout
            contents, at = [], 0
            for _ in range(len(pdf)):
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[2])
                contents.append(out[end + 1 : end + 1 + size])
                at = end + size + 2
            yield pd.DataFrame({"path": pdf["path"], "modified": pdf["modified"], "length": pdf["length"], "content": pd.Series(contents, dtype=object, index=pdf.index)})

    return read


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every file under a local folder, by names alone."""
    found = [(os.path.relpath(os.path.join(d, f), root).replace(os.sep, "/"),) for d, _, names in os.walk(root) for f in names]
    return spark.createDataFrame(found, "path string")
