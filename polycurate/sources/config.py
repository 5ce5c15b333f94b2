"""Configuration files: YAML (of which JSON is a part), merged over defaults, written back after a search."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .io import parameter_table

try:
    import yaml
except ImportError:  # then only JSON is read and written
    yaml = None


def merged(default: dict, own: dict | None, by_key: tuple[str, ...] = ("per_language",)) -> dict:
    """default with own entries over it. An entry replaces the default's whole value; tables named in by_key are merged by key, their entries whole."""
    own = own or {}
    out = default | own
    for name in by_key:
        if name in default or name in own:
            out[name] = (default.get(name) or {}) | (own.get(name) or {})
    return out


def read_config(path: str | None, default: dict, by_key: tuple[str, ...] = ("per_language",)) -> dict:
    """The file's entries over the defaults; the defaults where there is no file."""
    if path is None or not Path(path).exists():
        return merged(default, None, by_key)
    text = Path(path).read_text(encoding="utf-8")
    return merged(default, yaml.safe_load(text) if yaml else json.loads(text), by_key)


def write_config(path: str, config: dict) -> None:
    text = yaml.safe_dump(config, default_flow_style=False, allow_unicode=True, sort_keys=False) if yaml else json.dumps(config, ensure_ascii=False, indent=2)
    Path(path).write_text(text, encoding="utf-8")


def write_back(path: str, section: str, best: DataFrame, key: str = "subset") -> dict:
    """Sets config[section]["per_language"] to one entry per row of best (a search's winners: one row for each language)."""
    config = read_config(path, {}, ())
    config.setdefault(section, {})["per_language"] = {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in best.collect()}
    write_config(path, config)
    return config


def language_table(spark: SparkSession, config: dict, default: dict, key: str = "subset") -> DataFrame:
    """config["per_language"] as a table, one row for each language, with the defaults where an entry lacks a value."""
    return parameter_table(spark, default, config.get("per_language") or {}, key)
