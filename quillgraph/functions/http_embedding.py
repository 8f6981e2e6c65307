"""An embedding provider over HTTP: ``{"model", "input": [text, ...]}`` is posted, ``{"embeddings": [[number, ...], ...]}`` comes back."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request

from .vectors import Embedder, EmbeddingError, register_provider

MAX_REPLY = 64 * 1024 * 1024


def http_embedder(url: str, model: str, dimensions: int, timeout: float = 30.0) -> Embedder:
    """Texts to vectors by requests from where the function runs, so on a cluster every executor must reach ``url``."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https") or timeout <= 0:
        raise EmbeddingError("invalid_options", "an http(s) address and a positive timeout are needed")

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": model, "input": texts, "dimensions": dimensions}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                data = reply.read(MAX_REPLY + 1)
        except urllib.error.HTTPError as e:
            raise EmbeddingError("http_error", f"the provider answered {e.code}") from e
        except TimeoutError as e:
            raise EmbeddingError("timeout", f"no answer within {timeout} seconds") from e
        except urllib.error.URLError as e:
            code = "timeout" if isinstance(e.reason, TimeoutError) else "unavailable"
            raise EmbeddingError(code, f"the provider can't be reached: {e.reason}") from e
        except OSError as e:
            raise EmbeddingError("unavailable", f"the provider can't be reached: {e}") from e
        if len(data) > MAX_REPLY:
            raise EmbeddingError("invalid_response", f"the answer is over {MAX_REPLY} bytes")
        try:
            rows = json.loads(data)["embeddings"]
            vectors = [[float(x) for x in v] for v in rows]
        except (ValueError, KeyError, TypeError) as e:
            raise EmbeddingError("invalid_response", "the answer holds no list of vectors") from e
        if any(not any(v) for v in vectors):
            raise EmbeddingError("empty_vector", "a vector is empty or zero")
        return vectors

    return embed


def register_http(name: str, url: str, timeout: float = 30.0) -> None:
    """Makes ``name`` a provider whose models ``url`` serves."""
    http_embedder(url, "", 1, timeout)  # its options are sound
    register_provider(name, lambda model, dimensions: http_embedder(url, model, dimensions, timeout))
