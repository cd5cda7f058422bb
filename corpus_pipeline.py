"""The corpus pipeline of five stages: language, toxicity, near duplicates, decontamination, mixing (``quire.llm.pipeline``)."""

from quire.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
