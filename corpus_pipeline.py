"""The corpus pipeline: STAGES, ORACLE_SQL and run, as threadloom.llm.pipeline has them."""

from threadloom.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
