"""Stable identifiers and hashes, as Columns and on the driver."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: str, value: Column) -> Column:
    """kind, a colon and the first 20 hex digits of a SHA-1 over both."""
    return F.concat(F.lit(kind + ":"), F.substring(F.sha1(F.concat(F.lit(kind + ":"), value).cast("binary")), 1, 20))


def stable_id_py(kind: str, value: str) -> str:
    return f"{kind}:{hashlib.sha1(f'{kind}:{value}'.encode()).hexdigest()[:20]}"


def content_hash(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def canonical_json(value: Any) -> str:
    """JSON with keys sorted at every depth and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: Any) -> str:
    return content_hash(canonical_json(value))
