"""Operators of a training-data pipeline, one module each.

Importing the package registers the eleven queries in :data:`QUERIES` and,
where SQL can express one, its DuckDB statement in :data:`ORACLES`.  Nothing
outside this package (and ``corpus_pipeline.py``) imports it.
"""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import queries  # noqa: F401,E402
