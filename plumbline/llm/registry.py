"""The modules of this subpackage that define ``QUERIES`` and ``SQL``."""

from __future__ import annotations

import importlib
from types import ModuleType

NAMES = ("capping", "percentiles", "names", "history", "canonical", "truncation", "encoding", "leakage", "lookalike")


def modules() -> list[ModuleType]:
    """All of them, imported."""
    return [importlib.import_module(f"plumbline.llm.{n}") for n in NAMES]
