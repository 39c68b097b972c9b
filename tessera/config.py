"""Engine settings, frozen; environment variables of the same name override the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    CHUNK_SIZE: int = 800
    CHUNK_OVERLAP: int = 200
    USE_CODE_AWARE_SPLITTING: bool = True
    EMBEDDING_DIMENSION: int = 768
    TOP_K_RESULTS: int = 7
    HYBRID_SEARCH_ALPHA: float = 0.6
    FUSION_METHOD: str = "rrf"
    USE_SEARCH_HEURISTICS: bool = True
    USE_RERANKER: bool = False
    USE_CONTEXTUAL_PREFIX: bool = True
    USE_DOMAIN_PROMPTS: bool = True
    USE_QUERY_RESPONSE_CACHE: bool = True
    CACHE_MAX_SIZE: int = 1000
    CACHE_SIMILARITY_THRESHOLD: float = 0.95
    CACHE_TTL_SECONDS: int = 3600
    BM25_K1: float = 1.5
    BM25_B: float = 0.75
    RRF_K: int = 60
    DOCS_BASE_URL: str = "https://kubernetes.io/docs"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Case-sensitive; unknown variables are ignored."""
        env = dict(os.environ) if env is None else env
        kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
        return cls(**{f.name: kinds[str(f.type)](env[f.name]) for f in fields(cls) if f.name in env})


DEFAULTS = Settings()
