"""Importing this package registers every bundled parser."""

from sparklog.operators.parsers import apache_access, windows_service  # noqa: F401
from sparklog.operators.parsers.registry import PARSED, get_parser, known_log_types, register

__all__ = ["PARSED", "get_parser", "known_log_types", "register"]
