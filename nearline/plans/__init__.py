"""Query catalogue (importing this package registers every query)."""

from .registry import REGISTRY, QuerySpec, register  # noqa: F401
from . import q_lsh, q_text, q_filters, q_minhash, q_vectors, q_graph, q_metrics, q_misc, q_store  # noqa: F401,E401
