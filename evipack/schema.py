"""Settings and the columns of the item table."""

from dataclasses import dataclass

ITEM_COLUMNS = (
    "source", "source_ref", "doc_id", "kind", "title", "content", "fields", "fact_key", "fact_value",
    "observed_at", "timestamp_precision", "scope", "confidence", "content_hash",
)

# How far each kind of source is trusted, and why.
CONFIDENCE = {
    "press_release": (0.90, "verbatim primary text"),
    "record": (0.75, "record extracted by an LLM from the release"),
    "financial_fact": (0.85, "deterministic parse of a reported table"),
    "internal_note": (0.60, "informal message, not verified"),
}
# Retrieval channels, their kind and their label in explanations.
CHANNELS = {
    "lexical": ("text", "lexical match"),
    "lexical_ctx": ("text", "lexical match (contextual index)"),
    "dense": ("vector", "semantic match"),
    "dense_ctx": ("vector", "semantic match (contextual index)"),
}


@dataclass(frozen=True)
class Settings:
    top_k: int = 30
    wide: int = 5
    rrf_k: int = 60
    max_items: int = 8
    per_doc_cap: int = 2
    min_coverage: float = 0.3
    semantic_rank_ok: int = 10
    rerank_min_score: float = 4.0
    fresh_days: int = 90
    stale_days: int = 365
    chunk_chars: int = 1400
    quote_chars: int = 280
    budget_tokens: int = 1500


DEFAULTS = Settings()
