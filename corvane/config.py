"""Settings: a global file under a project's, with silent defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    default_budget: int = 8000
    max_budget: int = 999_999
    cache_seconds: int = 300
    tokens_per_bytes: int = 4


def load(*paths: str) -> Config:
    """Later files win; missing and malformed ones, unknown keys and wrong types are ignored."""
    values: dict = {}
    known = {f.name: type(f.default) for f in fields(Config)}
    for path in paths:
        try:
            with open(os.path.expanduser(path), encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(data, dict):
            values |= {k: v for k, v in data.items() if k in known and isinstance(v, known[k]) and not isinstance(v, bool)}
    return Config(**values)
