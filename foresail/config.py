"""Parameters of the engine, with the defaults of a deployed model."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

SMOOTHING = ("mle", "laplace", "stupid_backoff", "kneser_ney")


# Defaults that results depend on.
@dataclass(frozen=True)
class EngineConfig:
    unk: str = "<UNK>"
    bos: str = "<s>"
    eos: str = "</s>"
    min_freq: int = 2
    max_vocab: int = 50_000
    min_sentence_tokens: int = 2
    train: float = 0.8
    dev: float = 0.1
    test: float = 0.1
    seed: int = 42
    order: int = 3
    smoothing: str = "stupid_backoff"
    add_k: float = 1.0
    backoff_alpha: float = 0.4
    discount: float = 0.75
    prune_min_count: int = 2
    prune_max_continuations: int = 50
    suggestions: int = 3
    min_prefix_len: int = 1
    pool: int = 50
    score_floor: float = -30.0
    suggest_punctuation: bool = True
    lambda_max: float = 0.4
    growth_tokens: int = 5000
    profile_cap: int = 200_000
    hmm_k: float = 0.01
    unknown_strategy: str = "suffix"
    unknown_prior: str = "hapax"
    rerank_alpha: float = 0.1
    tag_window: int = 2
    unknown_tag_penalty: float = -2.0

    def __post_init__(self):
        if self.order < 1:
            raise ValueError("order must be 1 or more")
        if self.smoothing not in SMOOTHING:
            raise ValueError(f"smoothing must be one of {SMOOTHING}")
        if abs(self.train + self.dev + self.test - 1.0) > 1e-6:
            raise ValueError("split fractions must sum to 1")
        if self.hmm_k <= 0:
            raise ValueError("hmm_k must be above 0")
        if self.unknown_strategy not in ("suffix", "uniform", "most_frequent_tag"):
            raise ValueError("unknown_strategy")
        if self.unknown_prior not in ("hapax", "laplace"):
            raise ValueError("unknown_prior")

    def override(self, **kw) -> EngineConfig:
        unknown = set(kw) - {f.name for f in fields(self)}
        if unknown:
            raise KeyError(f"no such parameter: {sorted(unknown)}")
        return replace(self, **kw)


DEFAULT = EngineConfig()

#: names the file of settings that settings() reads where no path is given
CONFIG_VARIABLE = "FORESAIL_CONFIG"


def load_settings(path: str | None = None) -> dict:
    """Nested settings of a YAML file, or of the file that the environment names; an empty file has none."""
    import yaml

    path = path or os.environ.get(CONFIG_VARIABLE)
    if not path:
        raise FileNotFoundError(f"give a path or set {CONFIG_VARIABLE}")
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"settings must be a mapping, not {type(found).__name__}")
    return found


_MISSING = object()


def setting(settings: dict, key: str, default=_MISSING):
    """The value of a dotted key; without a default, a missing one is an error."""
    node = settings
    for part in key.split("."):
        node = node.get(part, _MISSING) if isinstance(node, dict) else _MISSING
        if node is _MISSING:
            if default is _MISSING:
                raise KeyError(f"required setting missing: {key!r}")
            return default
    return node


def from_settings(settings: dict) -> EngineConfig:
    """A configuration from settings whose last parts of names are parameters, in any nesting; other names are left alone."""
    names, flat = {f.name for f in fields(EngineConfig)}, {}

    def walk(node):
        for key, value in node.items():
            if isinstance(value, dict):
                walk(value)
            elif key in names:
                flat[key] = value

    walk(settings)
    return EngineConfig(**flat)
