"""Encoders of text to vectors, by name. Others register themselves; none is taken in place of one that isn't there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from papercairn.functions.python import hash_encode

Encoder = Callable[[Column, int, bool], Column]
_ENCODERS: dict[str, Encoder] = {"hash": lambda text, dim, is_query: hash_encode(text, dim)}


def register(name: str, encoder: Encoder) -> None:
    """encoder(text, dim, is_query) gives an array<float> column of length `dim`."""
    _ENCODERS[name] = encoder


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        raise KeyError(f"no encoder named {name}; there are {', '.join(sorted(_ENCODERS))}")
    return _ENCODERS[name]


def encode(text: Column, name: str = "hash", dim: int = 256, is_query: bool = False) -> Column:
    return encoder(name)(text, dim, is_query)
