"""Engine settings, readable from ``key: value`` files."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    corpus_prefix: str = ""
    index_prefix: str = ""
    log_prefix: str = ""
    indexer_type: str = "inverted-compressed"
    corpus_analyzer_type: str = "pagerank"
    log_miner_type: str = "numviews"
    stopwords_n: int = 70
    ql_lambda: float = 0.5
    damping: float = 0.1
    pagerank_iterations: int = 2
    results: int = 10
    prf_documents: int = 10
    prf_terms: int = 10
    prf_min_probability: float = 0.05
    suggestions: int = 5
    #: ``plain`` or ``full``: how documents and queries become terms.
    analyzer: str = "plain"

    REQUIRED = ("corpus_prefix", "index_prefix", "log_prefix", "indexer_type", "corpus_analyzer_type", "log_miner_type")
    INDEXERS = ("fullscan", "inverted-doconly", "inverted-occurrence", "inverted-compressed")

    @classmethod
    def parse(cls, text: str) -> EngineConfig:
        """Lines of ``key: value``; ``#`` starts a comment line; unknown keys are ignored."""
        found: dict[str, str] = {}
        for line in map(str.strip, text.splitlines()):
            if not line or line.startswith("#"):
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a setting: {line}")
            found[key.strip()] = value.strip()
        if missing := [k for k in cls.REQUIRED if k not in found]:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        if found["indexer_type"] not in cls.INDEXERS:
            raise ValueError(f"unknown indexer_type: {found['indexer_type']}")
        if found.get("analyzer", "plain") not in ("plain", "full"):
            raise ValueError(f"unknown analyzer: {found['analyzer']}")
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in found.items() if k in kinds})
