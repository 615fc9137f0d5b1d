"""Profiles from files, checked before they are used."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

from quirelane.operators.profiles import Profile

_FORBIDDEN = re.compile(r"(?i)pass(?:word|wd)|secret|token|api[_-]?key|credential|private[_-]?key")


def forbidden_keys(value, place: str = "") -> list[str]:
    """Places of keys that look like credentials, in nested values."""
    out = []
    if isinstance(value, Mapping):
        for k, v in value.items():
            at = f"{place}.{k}" if place else str(k)
            if _FORBIDDEN.search(str(k)):
                out.append(at)
            out += forbidden_keys(v, at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += forbidden_keys(v, f"{place}[{i}]")
    return out


def parse(value: Mapping) -> Profile:
    if bad := forbidden_keys({k: v for k, v in value.items() if k not in ("match", "fields")} | {"fields": list(value.get("fields", {}))}):
        raise ValueError(f"profiles hold no credentials: {', '.join(bad)}")
    if not value.get("name") or not isinstance(value.get("match"), Mapping):
        raise ValueError("a profile needs a name and a match tree")
    return Profile(value["name"], value["match"], int(value.get("priority", 0)), value.get("fields", {}))


def load(paths: Iterable[str]) -> list[Profile]:
    """Profiles of JSON files, or of YAML files where that library is installed; later names replace earlier ones."""
    found: dict[str, Profile] = {}
    for p in paths:
        text = Path(p).read_text(encoding="utf-8")
        if p.endswith((".yaml", ".yml")):
            import yaml

            value = yaml.safe_load(text)
        else:
            value = json.loads(text)
        for v in value if isinstance(value, list) else [value]:
            profile = parse(v)
            found[profile.name] = profile
    return list(found.values())
