"""Settings of matching, extraction, metrics and evaluation."""

from __future__ import annotations

import os
from dataclasses import MISSING, dataclass, field, fields, replace
from typing import Any

# Words that never match as parts of others.
STOPWORDS = ("a", "an", "the", "it", "its", "is", "of", "to", "in", "on", "at", "and", "or", "this", "that", "these", "those", "he", "she", "they", "we", "you")


@dataclass(frozen=True)
class MatchConfig:
    entity_sim_threshold: float = 0.90
    relation_sim_threshold: float = 0.75
    allow_substring_match: bool = True
    direction_sensitive_edges: bool = True
    inverse_edge_match: bool = False
    min_substring_chars: int = 2
    stopwords: tuple[str, ...] = STOPWORDS
    embedding_model: str = "letter counts"

    def with_thresholds(self, entity: float, relation: float) -> MatchConfig:
        return replace(self, entity_sim_threshold=entity, relation_sim_threshold=relation)


@dataclass(frozen=True)
class ExtractConfig:
    model: str = "offline"
    api_base: str | None = None
    temperature: float = 0.0
    cluster: bool = False
    context_chunk_chars: int = 6000
    max_retries: int = 5
    backoff_multiplier: float = 2.0
    concurrency: int = 4
    calls_per_task: int = 4
    calls_per_second: float | None = None
    own_chunks: bool = False
    api_key_env: str = "EXTRACTOR_API_KEY"


@dataclass(frozen=True)
class EvalConfig:
    alpha: float | None = None
    alpha_grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    empty_response_graph_policy: str = "report_both"
    empty_response_impute_h: float = 0.5
    histograms: bool = True
    cv_folds: int = 5
    bootstrap_replicates: int = 1000
    seed: int = 42
    sweep_entity: tuple[float, ...] = (0.85, 0.90, 0.95)
    sweep_relation: tuple[float, ...] = (0.65, 0.75, 0.85)
    sweep_answers: int = 300
    context_length_edges: tuple[int, ...] = (0, 1000, 2000, 4000, 8000, 16000, 1_000_000)


@dataclass(frozen=True)
class DataConfig:
    dir: str = "data"
    exclude_implicit_true: bool = False
    splits: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Config:
    match: MatchConfig = field(default_factory=MatchConfig)
    extract: ExtractConfig = field(default_factory=ExtractConfig)
    evaluate: EvalConfig = field(default_factory=EvalConfig)
    data: DataConfig = field(default_factory=DataConfig)
    cache_dir: str | None = None
    output_dir: str = "results"


#: Sections and settings under other names that configuration files may use: fixed values.
OTHER_SECTIONS = {"llm": "extract", "extraction": "extract", "matching": "match", "metrics": "evaluate", "eval": "evaluate"}
OTHER_NAMES = {
    "retry_backoff_base_s": "backoff_multiplier", "n_bootstrap": "bootstrap_replicates", "alpha_cv_folds": "cv_folds", "tau_e_sweep": "sweep_entity", "tau_r_sweep": "sweep_relation",
    "sweep_limit": "sweep_answers", "context_length_buckets": "context_length_edges", "make_plots": "histograms",
}


def _section(kind: type, given: dict[str, Any]) -> Any:
    named = {OTHER_NAMES.get(k, k): v for k, v in given.items()}
    if extra := set(named) - {f.name for f in fields(kind)}:
        raise AttributeError(f"unknown settings: {sorted(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in named.items()})


def load_config(path: str) -> Config:
    """Reads a YAML (or JSON) mapping with the sections match, extract, evaluate and data, or those of OTHER_SECTIONS, cache_dir and output_dir."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        given = json.loads(text)
    else:
        given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no mapping")
    kinds = {f.name: f.default_factory for f in fields(Config) if f.default_factory is not MISSING}
    plain, sections = {}, {k: {} for k in kinds}
    for name, value in given.items():
        section = OTHER_SECTIONS.get(name, name)
        if section in sections:
            sections[section] |= value or {}
        elif section in {f.name for f in fields(Config)}:
            plain[section] = value
        else:
            raise AttributeError(f"unknown section: {name}")
    return Config(**plain, **{k: _section(kinds[k], v) for k, v in sections.items()})


def resolve_api_key(config: ExtractConfig) -> str | None:
    """The value of the environment variable that the configuration names."""
    return os.environ.get(config.api_key_env) or None
