"""Settings from layers of files and the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def parse(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines and comments are left out, one pair of quotes around a value goes."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, found, value = line.strip().partition("=")
        if not found or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip()] = value
    return out


@dataclass(frozen=True)
class Setting:
    value: str
    origin: str


def resolve(defaults: Mapping[str, str], layers: list[tuple[str, str | None]], environ: Mapping[str, str]) -> tuple[dict[str, Setting], list[tuple[str, bool]]]:
    """(each setting with where it comes from, each layer's name and whether there was one). layers: name and text (None: no such file),
    later ones win; the environment wins over all, and an empty value falls back to the default."""
    merged: dict[str, Setting] = {}
    for name, text in layers:
        merged |= {k: Setting(v, name) for k, v in parse(text or "").items()}
    merged |= {k: Setting(v, "env") for k, v in environ.items() if k in defaults and v != getattr(merged.get(k), "value", None)}
    out = {k: Setting(v, "default") for k, v in defaults.items()} | {k: s for k, s in merged.items()}
    out = {k: s if s.value or k not in defaults else Setting(defaults[k], s.origin) for k, s in out.items()}
    return out, [(name, text is not None) for name, text in layers]
