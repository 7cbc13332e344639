"""Query plans over the driver's tables."""

from importlib import import_module

from .registry import QUERIES, SQL

for _name in ("row_queries", "text_queries", "structure_queries", "corpus_queries", "extraction_queries", "conflict_queries", "repair_queries", "matching_queries", "phrase_queries"):
    import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "SQL"]
