"""The graph's tables on any file system that Spark writes, swapped in whole.

A version is a folder of Parquet tables; a pointer file names the current
one and is replaced by one rename, so readers see the old version or the new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import PARSED_SCHEMA
from ..model import SCHEMAS, Config, GraphTables
from ..operators import fts
from ..operators.build import build_graph, with_edges
from ..operators.nodes import both_ends
from ..operators.related import replace_derived

SCHEMA_VERSION = 1
#: By what the rows of each table are looked up.
_LOOKUPS = {
    "documents": ("id",), "sections": ("id", "document_id"), "entities": ("id", "normalized_name"), "source_refs": ("id", "normalized_path"),
    "edges": ("from_id", "to_id", "id"), "chunks": ("document_id", "section_id", "id"), "chunk_vectors": ("chunk_id",),
}
_POINTER = "_CURRENT"


class StoreError(Exception):
    pass


class GraphStore:
    """Versions of a graph under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ file system
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path(_POINTER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        if not self._fs().exists(self._path(name)):
            return None
        stream = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        fs, temporary = self._fs(), self._path(f"_new-{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(temporary), fs.makeQualified(self._path(name)), options)

    # --------------------------------------------------------------- versions
    def current(self) -> dict | None:
        text = self._read(_POINTER)
        if text is None:
            return None
        about = json.loads(text)
        if about["schema_version"] > SCHEMA_VERSION:
            raise StoreError(f"the index was written by a later version ({about['schema_version']})")
        return about

    def save(self, graph: GraphTables, parsed: DataFrame | None = None, old: GraphTables | None = None) -> str:
        """Writes a version and makes it current; gives its name.  ``old``: the version before, whose postings of unchanged chunks are taken over."""
        version = f"v-{uuid.uuid4().hex}"
        for name, df in graph.items():
            self._write_table(df, f"{self.root}/{version}/{name}", *_LOOKUPS[name])
        self._write_table(both_ends(self._table(version, "edges", SCHEMAS["edges"])).repartition("node"), f"{self.root}/{version}/adjacency", "node")
        chunks = self._table(version, "chunks", SCHEMAS["chunks"])
        self._postings(chunks, old).repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{self.root}/{version}/postings")
        fts.totals(chunks, "content").coalesce(1).write.parquet(f"{self.root}/{version}/text_totals")
        if parsed is not None:
            parsed.write.parquet(f"{self.root}/{version}/parsed")
        self._write(_POINTER, json.dumps({"version": version, "schema_version": SCHEMA_VERSION, "parsed": parsed is not None, "postings": True}))
        return version

    @staticmethod
    def _write_table(df: DataFrame, path: str, *keys: str) -> None:
        """Sorted by the first key within its files and with Bloom filters, so that lookups by key skip most of them."""
        writer = df.sortWithinPartitions(*keys[:1]).write
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(path)

    @staticmethod
    def _postings(chunks: DataFrame, old: GraphTables | None) -> DataFrame:
        if old is None or "postings" not in old.extra:
            return fts.postings(chunks, "id", "content")
        pair = lambda df: df.select("id", F.xxhash64("content").alias("h"), F.sha1(F.col("content").cast("binary")).alias("s"))
        same = pair(chunks).join(pair(old.chunks), ["id", "h", "s"], "left_semi").select("id")
        kept = old.extra["postings"].join(same, "id", "left_semi").select("term", "id", "indexed", "plain", "len")
        return kept.unionByName(fts.postings(chunks.join(same, "id", "left_anti"), "id", "content"))

    def _table(self, version: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{name}")

    def load(self) -> GraphTables:
        about = self.current()
        if about is None:
            raise StoreError("nothing is indexed here")
        graph = GraphTables(*[self._table(about["version"], name, schema) for name, schema in SCHEMAS.items()])
        if about["parsed"]:
            graph.extra["parsed"] = self._table(about["version"], "parsed", PARSED_SCHEMA)
        if about.get("postings"):
            graph.extra["adjacency"] = self._table(about["version"], "adjacency", f"node string, {SCHEMAS['edges']}")
            graph.extra["postings"] = self._table(about["version"], "postings", fts.POSTINGS_SCHEMA)
            graph.extra["text_totals"] = self._table(about["version"], "text_totals", fts.TOTALS_SCHEMA)
        return graph

    def prune(self) -> int:
        """Deletes all versions but the current one; gives their number."""
        about, fs, n = self.current(), self._fs(), 0
        for status in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and (about is None or name != about["version"]):
                fs.delete(status.getPath(), True)
                n += 1
        return n

    def size(self) -> int:
        about = self.current()
        return int(self._fs().getContentSummary(self._path(about["version"])).getLength()) if about else 0

    # ----------------------------------------------------------------- updates
    def index(self, parsed: DataFrame, config: Config | None = None, indexed_at: str | None = None) -> GraphTables:
        """A full index: parsed files are stored first, as every table reads them."""
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        parsed.write.parquet(staged)
        stored = self.spark.read.schema(PARSED_SCHEMA).parquet(staged)
        self.save(build_graph(stored, config, indexed_at), stored)
        self._fs().delete(self._path(staged.rsplit("/", 1)[1]), True)
        return self.load()

    def refresh(self, files: DataFrame, config: Config | None = None, indexed_at: str | None = None, parse=None) -> tuple[GraphTables, dict[str, int]]:
        """Indexes what changed: only files whose content differs are parsed again.

        ``files``: path, modified, length, content.  Derived edges between
        documents that remain are carried over.  Where nothing changed since the
        last version, it stays.
        """
        from .markdown import parse_files

        about = self.current()
        if about is None or not about["parsed"]:
            graph = self.index((parse or parse_files)(files), config, indexed_at)
            return graph, {"parsed": graph.extra["parsed"].count(), "kept": 0, "deleted": 0}
        old = self.load()
        same, fresh = self.reparse(files, parse or parse_files)
        gone = old.extra["parsed"].join(files.select("path"), "path", "left_anti").count()
        kept = same.count()
        about_files = files.agg(F.count(F.lit(1)).alias("n"), F.max("modified").alias("latest")).first()
        indexed = old.documents.agg(F.min(F.to_timestamp("indexed_at"))).first()[0]
        if kept == about_files["n"] and not gone and (not kept or indexed is not None and about_files["latest"] <= indexed):  # else times are to be renewed
            return old, {"parsed": 0, "kept": kept, "deleted": 0}
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        same.unionByName(fresh).write.parquet(staged)
        stored = self.spark.read.schema(PARSED_SCHEMA).parquet(staged)
        graph = build_graph(stored, config, indexed_at)
        ids = graph.documents.select("id")
        derived = old.edges.where("kind = 'RELATED_TO' AND provenance = 'embedding_similarity'")
        derived = derived.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        graph = with_edges(graph, replace_derived(graph.edges, derived.select(graph.edges.columns)))
        self.save(graph, stored, old)
        self._fs().delete(self._path(staged.rsplit("/", 1)[1]), True)
        loaded = self.load()
        return loaded, {"parsed": loaded.extra["parsed"].count() - kept, "kept": kept, "deleted": gone}

    def reparse(self, files: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
        """(stored records of the files whose content is the same, records of the others): only these are parsed."""
        before = self.load().extra["parsed"]
        hashed = files.withColumn("__hash", F.sha2(F.decode("content", "UTF-8").cast("binary"), 256))
        same = before.join(hashed.select("path", F.col("__hash").alias("hash")), ["path", "hash"], "left_semi").select(before.columns)
        changed = hashed.join(before.where("error IS NULL").select("path", F.col("hash").alias("__hash")), ["path", "__hash"], "left_anti").drop("__hash")
        return same, parse(changed)

    def replace_related(self, derived: DataFrame) -> GraphTables:
        """Swaps the derived edges of the current version in one step."""
        graph = self.load()
        self.save(with_edges(graph, replace_derived(graph.edges, derived)), graph.extra.get("parsed"), graph)
        return self.load()


def counts(graph: GraphTables) -> dict[str, int]:
    """Rows of each table, in one job."""
    rows = None
    for name, df in graph.items():
        one = df.select(F.lit(name).alias("t"))
        rows = one if rows is None else rows.union(one)
    found = {r["t"]: r["count"] for r in rows.groupBy("t").count().collect()}  # seven rows
    return {name: found.get(name, 0) for name, _ in graph.items()}
