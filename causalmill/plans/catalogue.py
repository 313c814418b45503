"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

from . import queries as _package
from .registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_package.__path__)):
    importlib.import_module(f"{_package.__name__}.{_m}")

__all__ = ["QUERIES", "ORACLES"]
