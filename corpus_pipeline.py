"""The corpus pipeline; its stages are those of ``reportmill.llm.pipeline``."""

from reportmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
