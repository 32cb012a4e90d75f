"""Typed settings: a base file, overlays in order, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass
class Chunking:
    strategy: str = "structural"
    size: int = 512
    overlap: int = 64


@dataclass
class Retrieval:
    mode: str = "dense"
    top_k: int = 5
    overfetch: int = 1
    prefetch: int = 50
    score_threshold: float | None = None


@dataclass
class Rules:
    enabled: list[str] = field(default_factory=list)
    source_cap: int = 2
    fence_tier: int = 1
    allowed_hosts: list[str] = field(default_factory=list)
    restrict_above: int = 1


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    rules: Rules = field(default_factory=Rules)
    max_context_chars: int = 6000

    def __post_init__(self):
        if self.retrieval.mode not in ("dense", "hybrid"):
            raise ValueError(f"unknown retrieval mode {self.retrieval.mode!r}")
        if self.retrieval.mode == "hybrid" and "corpus_segregation" in self.rules.enabled:
            raise ValueError("hybrid retrieval does not work on a segregated corpus")
        if self.retrieval.mode == "hybrid" and self.retrieval.score_threshold is not None:
            raise ValueError("a score threshold cannot be applied to fused ranks")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over on base; mappings merge, all else replaces."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def _typed(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings {extra} in {kind.__name__}")
    nested = {c.__name__: c for c in (Chunking, Retrieval, Rules)}
    return kind(**{k: _typed(nested[known[k].type], v or {}) if known[k].type in nested and not is_dataclass(v) else v for k, v in values.items()})


def from_environment(env: dict[str, str], prefix: str = "QUARRY_") -> dict[str, Any]:
    """QUARRY_RETRIEVAL__TOP_K=10 sets retrieval.top_k; values are YAML scalars, blank ones are ignored."""
    import yaml

    out: dict[str, Any] = {}
    for name, value in sorted(env.items()):
        if name.startswith(prefix) and value.strip():
            *path, last = name[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = yaml.safe_load(value)
    return out


def load(path: str | None = None, overlays: tuple[str, ...] = (), env: dict[str, str] | None = None) -> Config:
    import yaml

    values: dict[str, Any] = {}
    for p in (*((path,) if path else ()), *overlays):
        values = merged(values, yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {})
    return _typed(Config, merged(values, from_environment(dict(os.environ) if env is None else env)))


def load_dotenv(path: str, env: dict[str, str]) -> None:
    """Add NAME=value lines to env; names that are set stay, blank values are ignored."""
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#") and value.strip().strip("'\""):
            env.setdefault(name.strip(), value.strip().strip("'\""))
