"""Queries over the sample tables, each registered next to its check SQL."""

from panelcf.registry import describing, fitting, reading  # noqa: F401
from panelcf.registry.book import ENTRIES

__all__ = ["ENTRIES"]
