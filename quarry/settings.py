"""Parameters of retrieval, gating and evaluation, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed default values of the pipeline."""

    retrieve_k: int = 10
    use_k: int = 4
    sub_query_k: int = 6
    sub_query_limit: int = 4
    pool_k: int = 12
    chunk_size: int = 900
    chunk_overlap: int = 140
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    gate_score_threshold: float = 0.6
    gate_model_threshold: float = 0.5
    relevance_floor: float = 0.5
    no_retrieval_threshold: float = 0.9
    injection_drop: float = 0.9
    contradiction_block: float = 0.5
    evidence_drop: float = 0.1
    citation_confidence: float = 0.8
    snippet_chars: int = 240
    title_chars: int = 60
    history: int = 8
    min_interval_s: float = 1.5


#: Example prices in USD per million tokens, (input, output); callers pass their own.
PRICES = {"small": (0.10, 0.40), "large": (1.25, 5.00)}
DEFAULT = Settings()
