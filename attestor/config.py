"""Settings of a run. One immutable object is passed to builders; nothing is read from the environment."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import lexicons


@dataclass(frozen=True)
class EngineConfig:
    # retrieval
    top_k: int = 10
    vector_min_similarity: float = 0.25
    store_min_similarity: float = 0.30
    evidence_min_similarity: float = 0.12
    evidence_min_chars: int = 50
    fallback_trigger: float = 0.55
    sufficient_score: float = 0.55
    min_sufficient: int = 1
    early_stop: bool = False
    # rerank
    semantic_weight: float = 0.7
    rerank_min: float = 0.25
    rerank_sufficient: float = 0.55
    rerank_top_k: int = 10
    # stance
    stance_min_similarity: float = 0.55
    support_overlap: float = 0.42
    neutral_overlap: float = 0.18
    high_similarity: float = 0.72
    stance_top_k: int = 3
    # score
    valid_score: float = 0.55
    reliable_coverage: float = 0.35
    partial_coverage: float = 0.20
    support_rate: float = 0.60
    contradiction_rate: float = 0.40
    weights: tuple[float, float, float] = (0.60, 0.25, 0.15)
    index_min_score: float = 75.0
    # features
    features_min_chars: int = 120
    high_risk: float = 0.60
    medium_risk: float = 0.35
    # classifier
    chunk_chars: int = 1800
    max_chunks: int = 8
    true_threshold: float = 0.60
    fake_threshold: float = 0.60
    # claims
    claim_min_confidence: float = 0.15
    max_claims: int = 50
    # segments and chunks
    segment_size: int = 4
    segment_overlap: int = 1
    min_sentence_chars: int = 20
    min_segment_tokens: int = 15
    vector_chunk_chars: int = 800
    vector_chunk_overlap: int = 100
    # domains
    blocked_domains: tuple[str, ...] = tuple(lexicons.BLOCKED_DOMAINS)
    trusted_domains: tuple[str, ...] = tuple(lexicons.TRUSTED_DOMAINS)
    daily_limits: dict[str, int] = field(default_factory=lambda: dict(lexicons.DAILY_LIMITS))

    @classmethod
    def from_options(cls, options: dict[str, str]) -> "EngineConfig":
        """Settings from text values, as spark-submit arguments give them; values that do not parse keep the default."""
        chosen: dict = {}
        for name, kind in (("int", int), ("float", float)):
            for key, f in cls.__dataclass_fields__.items():
                if f.type == name and key in options:
                    try:
                        chosen[key] = kind(options[key])
                    except ValueError:
                        pass
        if options.get("blocked_domains"):  # these are blocked besides the fixed ones
            chosen["blocked_domains"] = tuple(sorted(set(lexicons.BLOCKED_DOMAINS) | domain_list(options["blocked_domains"])))
        if options.get("trusted_domains"):
            chosen["trusted_domains"] = tuple(sorted(domain_list(options["trusted_domains"])))
        if "early_stop" in options:
            chosen["early_stop"] = truth(options["early_stop"])
        return cls(**chosen)


def text_list(text: str | None) -> list[str]:
    """The parts of a comma-separated text, trimmed, empty ones dropped, each once in its order."""
    return list(dict.fromkeys(p.strip() for p in (text or "").split(",") if p.strip()))


def domain_list(text: str | None) -> set[str]:
    """The domains of a comma-separated text, in lower case, without a leading ``www.``."""
    return {d.lower().removeprefix("www.") for d in text_list(text)}


def label_set(text: str | None) -> set[str]:
    """Class labels of a comma-separated text as the classifier normalises them."""
    return {re.sub(r"[\s-]+", "_", p.lower()) for p in text_list(text)}


def truth(text: str) -> bool:
    return text.strip().lower() in {"1", "true", "yes", "y", "on", "sim", "s"}


DEFAULT = EngineConfig()
