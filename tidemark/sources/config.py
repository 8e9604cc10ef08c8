"""Reader configurations: JSON or TOML (YAML where its library is installed) to readers."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.sources.readers import TYPES, Both, joined

ALLOWED = {"id", "type", "enabled", "options"}


def loaded(path: str) -> list[dict]:
    """The ``readers`` of a file, checked: known types, distinct ids, no other keys."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix
    if kind == ".json":
        data = json.loads(text)
    elif kind == ".toml":
        data = tomllib.loads(text)
    elif kind in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(text)
    else:
        raise ValueError(f"not a configuration: {path}")
    if set(data) - {"readers"}:
        raise ValueError(f"unknown keys: {sorted(set(data) - {'readers'})}")
    seen: set[str] = set()
    for entry in data.get("readers", []):
        if extra := set(entry) - ALLOWED:
            raise ValueError(f"unknown keys: {sorted(extra)}")
        if entry.get("type") not in TYPES:
            raise ValueError(f"unknown reader type: {entry.get('type')}")
        if not entry.get("id") or entry["id"] in seen:
            raise ValueError(f"ids must be there and distinct: {entry.get('id')}")
        seen.add(entry["id"])
    return data.get("readers", [])


def read_all(spark: SparkSession, path: str) -> Both:
    return joined(*[TYPES[e["type"]](spark, **e.get("options", {})) for e in loaded(path) if e.get("enabled", True)])
