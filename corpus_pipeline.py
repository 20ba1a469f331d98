"""The corpus pipeline of five stages; its parts are in the training-data subpackage."""

from blockwright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
