"""Settings with the defaults of the tool whose behaviour we reproduce."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    max_tokens: int | None = None   # cleaned text budget; None reads whole texts
    top_k: int = 10                # keywords per entry
    keyword_backend: str = "tfidf"  # tfidf, embedding or topics
    keyword_diversity: float | None = None  # maximal marginal relevance; None: by score alone
    nr_topics: int | None = None   # topics are merged down to this number; None: none are merged
    topic_threshold: float = 0.01  # a topic below this probability is none
    min_cluster_size: int = 5      # density clustering
    min_samples: int | None = None  # defaults to min_cluster_size // 2
    n_clusters: int = 10           # k-means
    features: tuple = ("keyword", "path", "subdomain", "date")
    # boilerplate fitting
    min_domain_size: int = 3
    domain_samples: int | None = None  # texts a domain is learned from; None: all
    phrase_freq: float = 0.75
    ngram_range: tuple = (2, 10)
    # embeddings
    hash_dim: int = 384
    seed: int = 42
    filter_sequence: tuple = field(default=(
        "DEFAULT_IGNORE_PATTERNS", "CODE_PATTERNS", "LATEX_PATTERNS", "CITATION_PATTERNS",
        "METADATA_PATTERNS", "NAVIGATION_PATTERNS", "SEQUENCE_PATTERNS", "FORMATTING_PATTERNS"))

    def __post_init__(self):
        if self.max_tokens is not None and self.max_tokens < 10:
            raise ValueError("max_tokens must be at least 10")

    @property
    def effective_min_samples(self) -> int:
        return self.min_samples if self.min_samples is not None else max(1, self.min_cluster_size // 2)
