"""Embedding providers: choice by environment, names, and encoders for ``operators.search.embed_nodes``.

``GRAPHLOOM_EMBEDDING_PROVIDER`` is local, openai, google or minimax; unset, the first provider with a key is taken,
else local, which needs no service: it hashes words on the JVM side. Keys stay in the provider and its UDF; a failed
call fails its task, which Spark tries again.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from ..operators.search import hashing_encoder

BATCH, TIMEOUT = 100, 60


@dataclass(frozen=True)
class Provider:
    kind: str
    model: str
    base_url: str = ""
    api_key: str = ""

    def __repr__(self) -> str:
        return f"Provider({self.name()})"

    def name(self) -> str:
        """What is stored beside a vector."""
        return f"{self.kind}:{self.model}" + (f"@{host_key(self.base_url)}" if self.kind == "openai" else "")

    def available(self) -> bool:
        return self.kind == "local" or bool(self.api_key)

    def encoder(self) -> Callable:
        """A function from a column of texts to a column of vectors."""
        return hashing_encoder if self.kind == "local" else _remote(self)


def host_key(url: str) -> str:
    """Host and path of a service without scheme, credentials and a closing /embeddings, in lower case."""
    bare = url.removeprefix("https://").removeprefix("http://")
    bare = bare.partition("@")[2] if "@" in bare else bare
    return bare.rstrip("/").removesuffix("/embeddings").rstrip("/").lower()


def provider_from_env(env: Mapping[str, str] | None = None) -> Provider | None:
    """The provider asked for, or the first with a key; None if one is asked for that is unknown or has no key."""
    env = os.environ if env is None else env
    asked, model = env.get("GRAPHLOOM_EMBEDDING_PROVIDER", "").lower(), env.get("GRAPHLOOM_EMBEDDING_MODEL")
    # fixed values: default models and addresses of the public services
    known = {
        "openai": ("GRAPHLOOM_OPENAI_API_KEY", env.get("GRAPHLOOM_OPENAI_MODEL", "text-embedding-3-small"), env.get("GRAPHLOOM_OPENAI_BASE_URL", "https://api.openai.com/v1")),
        "google": ("GOOGLE_API_KEY", model or "gemini-embedding-001", "https://generativelanguage.googleapis.com/v1beta"),
        "minimax": ("MINIMAX_API_KEY", "embo-01", "https://api.minimax.chat/v1"),
    }
    for kind, (key, default, url) in known.items():
        if asked in ("", kind) and key in env:
            return Provider(kind, default, url, env[key])
    return Provider("local", model or "hashing") if asked in ("", "local") else None


def _request(p: Provider, texts: list[str]) -> tuple[str, dict, dict]:
    """Address, headers and body of a call."""
    base, bearer = p.base_url.rstrip("/"), {"Authorization": f"Bearer {p.api_key}"}
    if p.kind == "openai":
        return f"{base}/embeddings", bearer, {"model": p.model, "input": texts}
    if p.kind == "google":
        parts = [{"model": f"models/{p.model}", "content": {"parts": [{"text": t}]}} for t in texts]
        return f"{base}/models/{p.model}:batchEmbedContents", {"x-goog-api-key": p.api_key}, {"requests": parts}
    return f"{base}/embeddings", bearer, {"model": p.model, "texts": texts, "type": "query"}


def _vectors(kind: str, answer: dict) -> list[list[float]]:
    """The vectors of an answer in the order of the texts; an answer that says it failed raises."""
    if answer.get("error"):
        raise RuntimeError(f"{kind}: {answer['error']}")
    if kind == "google":
        return [e["values"] for e in answer["embeddings"]]
    if kind == "minimax":
        state = answer.get("base_resp") or {}
        if state.get("status_code"):
            raise RuntimeError(f"minimax: {state.get('status_msg')}")
        return answer["vectors"]
    items = answer["data"]
    numbered = [i for i in items if isinstance(i.get("index"), int)]
    if numbered and len(numbered) < len(items):
        raise RuntimeError("openai: some vectors are numbered and some are not")
    return [i["embedding"] for i in sorted(items, key=lambda i: i.get("index", 0))]


def encode_texts(p: Provider, texts: list[str]) -> list[list[float]]:
    """Vectors of texts, ``BATCH`` texts a call."""
    out: list[list[float]] = []
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        url, headers, body = _request(p, part)
        call = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=TIMEOUT) as answer:
            vectors = _vectors(p.kind, json.load(answer))
        if len(vectors) != len(part):
            raise RuntimeError(f"{p.kind}: {len(vectors)} vectors for {len(part)} texts")
        out += vectors
    return out


def _remote(p: Provider) -> Callable:
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(p, texts.fillna("").tolist()), index=texts.index)

    return encode
