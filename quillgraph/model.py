"""The graph's tables, enumerations and settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENT_KINDS = frozenset("spec design adr api runbook incident meeting guide memory other".split())
TRUST_TIERS = frozenset("authored generated validated external untrusted".split())
ENTITY_KINDS = ("symbol", "api_route", "error_code", "config_key", "file_path", "command", "package", "concept", "decision")
EDGE_WEIGHTS = {
    "CONTAINS": 5.0, "DEFINES": 10.0, "REFERENCES": 4.0, "DEPENDS_ON": 9.0, "LINKS_TO": 7.0, "IMPLEMENTS": 8.0,
    "REFERENCES_SOURCE": 6.0, "SUPERSEDES": 8.0, "DEPRECATED_BY": 8.0, "SAME_AS": 7.0, "RELATED_TO": 2.0, "CONTRADICTS": 6.0,
}
EXCLUDED = ("node_modules", "dist", "build", "coverage", ".git", ".quillgraph", ".next", ".turbo", ".cache", "temp", "tmp")


@dataclass(frozen=True)
class Config:
    """Settings; ``merged`` takes a mapping, ignores unknown keys and wrong types, and refuses numbers out of range."""

    include: tuple[str, ...] = ("**/*.md", "**/*.mdx")
    exclude: tuple[str, ...] = ()
    parse_mdx: bool = False
    follow_gitignore: bool = True
    max_file_bytes: int = 524_288
    default_limit: int = 8
    max_depth: int = 2
    max_context_chars: int = 28_000
    high_frequency_entity_threshold: int = 50
    enabled_kinds: tuple[str, ...] = ("symbol", "api_route", "error_code", "config_key", "file_path", "command", "package", "concept")
    stop_entities: tuple[str, ...] = ("Config", "Error", "Service", "API", "User", "Data")
    semantic: bool = False
    provider: str = "local-hash"
    embedding_model: str = "local-hash-v1"
    dimensions: int = 128
    batch_size: int = 16

    _BOUNDS = {
        "max_file_bytes": (1, 10_485_760), "default_limit": (1, 100), "max_depth": (0, 12), "max_context_chars": (1, 1_000_000),
        "high_frequency_entity_threshold": (1, 1_000_000), "dimensions": (1, 8_192), "batch_size": (1, 1_024),
    }

    def merged(self, given: dict) -> Config:
        out = {}
        for f in fields(self):
            if f.name not in given:
                continue
            old, new = getattr(self, f.name), given[f.name]
            if isinstance(old, tuple):
                if isinstance(new, (list, tuple)) and all(isinstance(x, str) for x in new):
                    out[f.name] = tuple(new)
            elif type(new) is type(old):
                low, high = self._BOUNDS.get(f.name, (None, None))
                if low is not None and not low <= new <= high:
                    raise ValueError(f"{f.name} must be from {low} to {high}, not {new}")
                out[f.name] = new
        return replace(self, **out)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else ddl


SCHEMAS = {
    "documents": "id string, path string, title string, type string, status string, hash string, trust_tier string, updated_at string, indexed_at string, tags array<string>, metadata_json string",
    "sections": "id string, document_id string, anchor string, heading string, level int, start_line int, end_line int, content string",
    "entities": "id string, name string, normalized_name string, kind string, namespace string, created_at string, metadata_json string",
    "source_refs": "id string, path string, normalized_path string, created_at string, metadata_json string",
    "edges": "id string, from_id string, to_id string, kind string, weight double, confidence double, provenance string, metadata_json string, created_at string",
    "chunks": "id string, document_id string, section_id string, content string, token_estimate int, metadata_json string",
    "chunk_vectors": "chunk_id string, provider string, model string, dimensions int, vector array<float>, created_at string",
}


@dataclass
class GraphTables:
    """The seven tables of an indexed corpus."""

    documents: DataFrame
    sections: DataFrame
    entities: DataFrame
    source_refs: DataFrame
    edges: DataFrame
    chunks: DataFrame
    chunk_vectors: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(k, getattr(self, k)) for k in SCHEMAS]
