"""The training-corpus pipeline: stages of documents, each written and read again."""

from folioquery.llm.pipeline import STAGES, run

#: Edit joins, sketches and merges aren't expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
