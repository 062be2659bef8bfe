"""All registered queries."""
from callscope.plans import (  # noqa: F401
    queries_corpus,
    queries_integrity,
    queries_io,
    queries_represent,
    queries_scoring,
    queries_selection,
    queries_stats,
    queries_stream,
    queries_text,
)
from callscope.plans.registry import ORACLES, QUERIES  # noqa: F401
