"""Settings: nested dictionaries, merged over defaults."""

from __future__ import annotations

from typing import Any


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """base with over laid on top, dictionary by dictionary; neither is changed."""
    out = dict(base)
    for key, value in (over or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out
