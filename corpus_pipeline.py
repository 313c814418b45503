"""Stages that turn ``documents`` into training data; each is written as Parquet and read again before the next."""

from __future__ import annotations

from causalmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
