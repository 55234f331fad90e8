"""Sources from a YAML file: a mapping of source id to settings under ``sources``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from sparklog.functions.clock import check_zone, parse_date

PATH_VARIABLE = "SPARKLOG_CONFIG"
DEFAULT_PATH = "config/config.yaml"


class ConfigError(ValueError):
    """The configuration is missing, unreadable or incomplete."""


@dataclass(frozen=True)
class SourceConfig:
    source_id: str
    log_type: str
    location: str | None = None
    timezone: str = "UTC"
    file_prefix: str = "log"
    header_pattern: str | None = None
    earliest_date: date | None = None
    pii_policy: dict[str, str] = field(default_factory=dict)
    #: "first_import": earliest_date bounds only a source's first run; "always": each run.
    cutoff: str = "first_import"
    #: "entry_hash": equal entries of a source are stored once in silver; "file_position": each stays.
    dedup: str = "entry_hash"

    @classmethod
    def from_dict(cls, source_id: str, raw: dict) -> SourceConfig:
        if not raw.get("log_type"):
            raise ConfigError(f"source {source_id!r} has no log_type")
        known = {k: raw[k] for k in cls.__dataclass_fields__ if k in raw and k != "source_id" and raw[k] is not None}
        made = cls(source_id=source_id, **known)
        try:
            check_zone(made.timezone)
            object.__setattr__(made, "earliest_date", parse_date(made.earliest_date))
        except ValueError as e:
            raise ConfigError(f"source {source_id!r}: {e}") from e
        if made.cutoff not in ("first_import", "always") or made.dedup not in ("entry_hash", "file_position"):
            raise ConfigError(f"source {source_id!r}: unknown cutoff or dedup")
        return made


def load_config(path: str | None = None) -> dict:
    """Path: the argument, else the environment variable, else the default."""
    import yaml

    where = Path(path or os.environ.get(PATH_VARIABLE) or DEFAULT_PATH)
    if not where.is_file():
        raise ConfigError(f"no configuration at {where}")
    try:
        found = yaml.safe_load(where.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError(f"{where} is not valid YAML: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{where} does not hold a mapping")
    return found


def _sources(path: str | None) -> dict:
    found = load_config(path).get("sources") or {}
    if not isinstance(found, dict):
        raise ConfigError("'sources' is not a mapping of source id to settings")
    return found


def list_sources(path: str | None = None) -> list[str]:
    return sorted(_sources(path))


def get_source_config(source_id: str, path: str | None = None) -> SourceConfig:
    found = _sources(path)
    if source_id not in found:
        raise ConfigError(f"unknown source {source_id!r}; known: {', '.join(sorted(found)) or 'none'}")
    return SourceConfig.from_dict(source_id, found[source_id] or {})
