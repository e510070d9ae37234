"""The corpus pipeline's stages, its ``run`` and its SQL: see ``foliant.llm.pipeline``."""

from foliant.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
