"""Settings: defaults, with those given laid over them."""

from __future__ import annotations

from copy import deepcopy

# Fixed values
DEFAULTS = {
    "chunk": {"target_tokens": 550, "max_tokens": 700, "min_tokens": 80, "overlap_sentences": 2},
    "search": {"rrf_k": 60, "dense_top_k": 50, "bm25_top_k": 50, "top_k": 8},
    "embedding": {"encoder": "hash", "dim": 1024, "normalize": True},
    "quality": {"pass_score": 0.6},
}


def merged(base: dict, over: dict | None) -> dict:
    """base with the values of `over`; mappings are merged level by level, all else is replaced."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def load(path: str | None = None) -> dict:
    """The defaults, with those of a YAML file over them."""
    if path is None:
        return deepcopy(DEFAULTS)
    import yaml

    with open(path, encoding="utf-8") as f:
        return merged(DEFAULTS, yaml.safe_load(f))
