"""All registered queries."""

from checks import ingest_queries, model_queries, recovery_queries, run_queries, store_queries, text_queries  # noqa: F401
from checks.registry import QUERIES, SQL  # noqa: F401
