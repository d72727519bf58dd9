"""The corpus pipeline: stages over ``documents``, each calling one operator."""

from __future__ import annotations

from tripcast.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
