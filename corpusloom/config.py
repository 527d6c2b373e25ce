"""Typed settings, read once from the environment and an optional ``.env`` file."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache
from pathlib import Path

# Result-defining constants of the retrieval model.
RRF_K = 60
RANK_ABSENT = 10**9
DOC_SUFFIXES = (".md", ".rst", ".txt")
CODE_SUFFIXES = (".py",)
SNIPPET_CHARS = 300
MAX_QUESTION_CHARS = 2000
MAX_TOP_K = 50


@dataclass(frozen=True)
class Settings:
    """Every knob of the library; field names double as environment names.

    Fixed values: the names and defaults of models, sizes and weights are those users of such systems have set.
    """

    store_path: str = ""
    default_namespaces: tuple[str, ...] = ()
    ignore_globs: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    retriever_top_k: int = 50
    reranker_type: str = "cross_encoder"
    cross_encoder_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    expose_retrieval_debug: bool = False

    use_mock_embeddings: bool = True
    dense_model_name: str = "BAAI/bge-base-en-v1.5"
    dense_dim: int = 768
    embed_batch_size: int = 32
    max_seq_length: int = 512

    use_mock_answers: bool = True
    answer_api_key: str = ""
    answer_model: str = ""
    answer_temperature: float = 0.2
    answer_max_tokens: int = 1024
    system_prompt: str = ""  # what an answer model is told, the user's to write

    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25


def _dotenv(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    pairs = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            pairs[key.strip()] = value.strip().strip("'\"")
    return pairs


def _cast(default: object, raw: str) -> object:
    if isinstance(default, bool):
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(default, int):
        return int(raw)
    if isinstance(default, float):
        return float(raw)
    if isinstance(default, tuple):
        return tuple(part.strip() for part in raw.split(",") if part.strip())
    return raw


def load_settings(env: Mapping[str, str] | None = None, dotenv: str = ".env") -> Settings:
    """Environment wins over the file; names match case-insensitively, extras are ignored."""
    merged = {k.lower(): v for k, v in _dotenv(Path(dotenv)).items()}
    merged.update({k.lower(): v for k, v in (os.environ if env is None else env).items()})
    base = Settings()
    overrides = {
        f.name: _cast(getattr(base, f.name), merged[f.name])
        for f in fields(Settings)
        if f.name in merged and f.name != "ignore_globs"
    }
    if "ignore_globs" in merged:  # JSON: namespace to list of globs
        overrides["ignore_globs"] = {k: tuple(v) for k, v in json.loads(merged["ignore_globs"]).items()}
    return replace(base, **overrides)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    return load_settings()
