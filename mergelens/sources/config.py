"""Configuration in scopes: defaults, then the user's file, the repository's and one named outright."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.schemas import MODES

#: Keys that a file may set; budgets merge one by one, lists replace each other whole.
KEYS = {"mode", "providers", "budgets.review_tokens", "budgets.agent_timeout_sec", "rules.include", "rules.sync"}
PROVIDER_KEYS = {"name", "model", "base_url", "api_key_env", "local"}
DEFAULTS: dict[str, Any] = {"mode": "offline", "providers": [], "budgets.review_tokens": 12_000, "budgets.agent_timeout_sec": 90, "rules.include": [], "rules.sync": []}
RESERVED = "MCAI_"


class ConfigError(ValueError):
    """Configuration that can't be used."""


def parse_config(text: str, source: str = "") -> tuple[dict[str, Any], list[str]]:
    """The keys that a document sets, flat, and warnings about others. Raises ConfigError for an empty or malformed one."""
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{source}: {e}") from e
    if not isinstance(doc, dict):
        raise ConfigError(f"{source}: the document is empty or no mapping")
    found: dict[str, Any] = {}
    warnings: list[str] = []
    for key, value in doc.items():
        inner = {f"{key}.{k}": v for k, v in value.items()} if key in ("budgets", "rules") and isinstance(value, dict) else {str(key): value}
        for k, v in inner.items():
            if k in KEYS:
                found[k] = v
            else:
                warnings.append(f"{source}: unknown key {k}")
    for p in found.get("providers") or []:
        warnings += [f"{source}: unknown key providers.{k}" for k in p if k not in PROVIDER_KEYS]
    return found, warnings


def merge(scopes: Sequence[dict[str, Any]]) -> dict[str, Any]:
    """The defaults under the scopes, the last to set a key winning, also if it sets the default."""
    out = dict(DEFAULTS)
    for s in scopes:
        out.update(s)
    return out


def merge_frame(settings: DataFrame, key: str = "key", value: str = "value", rank: str = "scope_rank") -> DataFrame:
    """The same over rows: of each key the value of the highest scope."""
    return settings.groupBy(key).agg(F.max_by(value, rank).alias(value))


def is_local(provider: dict[str, Any]) -> bool:
    """The flag if it is set, else whether there is no address."""
    return bool(provider["local"]) if provider.get("local") is not None else not provider.get("base_url")


def validate(config: dict[str, Any]) -> None:
    """Raises ConfigError."""
    if config["mode"] not in MODES:
        raise ConfigError(f"no such mode: {config['mode']!r}")
    for key in ("budgets.review_tokens", "budgets.agent_timeout_sec"):
        if not isinstance(config[key], int) or config[key] <= 0:
            raise ConfigError(f"{key} must be a positive number")
    for p in config["providers"] or []:
        if not str(p.get("name") or "").strip() or not str(p.get("model") or "").strip():
            raise ConfigError("a provider needs a name and a model")
        if str(p.get("api_key_env") or "").startswith(RESERVED):
            raise ConfigError(f"variables that begin with {RESERVED} are reserved")


def load(paths: Sequence[str]) -> tuple[dict[str, Any], list[str]]:
    """The configuration of files in rising precedence; a missing file is a warning."""
    scopes, warnings = [], []
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except FileNotFoundError:
            warnings.append(f"{path}: not found")
            continue
        found, notes = parse_config(text, path)
        scopes.append(found)
        warnings += notes
    config = merge(scopes)
    validate(config)
    return config, warnings


def load_for_repo(repo: str, user_file: str, explicit: str = "", name: str = ".mergelens/config.yaml") -> tuple[dict[str, Any], list[str]]:
    """User's file, the repository's, then the explicit one; of the first two only those that exist are read."""
    paths = [p for p in (user_file, os.path.join(repo, name)) if os.path.exists(p)]
    return load([*paths, *([explicit] if explicit else [])])
