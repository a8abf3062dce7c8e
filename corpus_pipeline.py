"""The corpus pipeline; see opsloom/llm/pipeline.py."""

from opsloom.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
