"""Limits of an analysis; each may be given, or read from the environment as a positive number."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass


def positive_number(text: str | None, default: float) -> float:
    """A positive finite number, whole or not; anything else is the default."""
    try:
        n = float(text.strip()) if text is not None else math.nan
    except ValueError:
        return default
    return n if math.isfinite(n) and n > 0 else default


@dataclass(frozen=True)
class PipelineConfig:
    """Budgets and thresholds of one analysis."""

    max_depth: float = 2
    max_urls: float = 50
    min_topic_overlap: float = 2
    max_urls_per_level: float = 15
    model_concurrency: float = 4
    max_phantom_edges: float = 15
    max_phantom_per_parent: float = 5
    max_phantom_depth: float = 1
    min_edge_relevance: float = 0.2
    min_page_chars: int = 200
    corroboration_similarity: float = 0.85
    same_article_words: int = 5
    same_article_jaccard: float = 0.8
    same_phantom_jaccard: float = 0.4
    max_match_pairs: int = 50
    cache_hours: int = 24
    chunk_threshold: int = 8_000
    chunk_target: int = 3_000
    chunk_overlap: int = 200
    max_classify_chars: int = 6_000
    max_extract_chars: int = 16_000
    max_edge_chars: int = 12_000

    @classmethod
    def from_env(cls, prefix: str = "PIPELINE_") -> PipelineConfig:
        names = ("max_depth", "max_urls", "min_topic_overlap", "max_urls_per_level", "model_concurrency", "max_phantom_edges", "max_phantom_per_parent", "max_phantom_depth")
        env = {"model_concurrency": "LLM_CONCURRENCY"}
        return cls(**{n: positive_number(os.environ.get(prefix + env.get(n, n.upper())), getattr(cls, n)) for n in names})
