"""Parsers by log type. A parser is built of Column expressions, never of per-row code."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from sparklog.functions.privacy import Policy
from sparklog.sources.config import SourceConfig


class Parser(Protocol):
    """What a log type must offer. ``parse`` adds to rows with ``raw_entry`` the columns of ``PARSED``."""

    log_type: str
    version: str
    header_pattern: str

    def parse(self, entries: DataFrame, config: SourceConfig, policy: Policy) -> DataFrame: ...

    def segments(self, exception_text: Column) -> Column:
        """Exception text to an array of signature texts, outermost first."""
        ...


#: Columns that ``parse`` adds.
PARSED = ("event_time_utc", "event_time_local", "severity", "severity_raw", "logger", "message", "is_exception", "exception_text", "extra_fields", "parsed")

_PARSERS: dict[str, Parser] = {}


def register(cls: type) -> type:
    """Class decorator: an instance becomes the parser of the class's ``log_type``."""
    name = getattr(cls, "log_type", "")
    if not name:
        raise ValueError(f"{cls.__name__} has no log_type")
    if name in _PARSERS:
        raise ValueError(f"log type {name!r} has a parser already")
    _PARSERS[name] = cls()
    return cls


def get_parser(log_type: str) -> Parser:
    if log_type not in _PARSERS:
        raise KeyError(f"no parser for {log_type!r}; known: {', '.join(known_log_types())}")
    return _PARSERS[log_type]


def known_log_types() -> list[str]:
    return sorted(_PARSERS)
