"""Registered queries: each a Spark plan over the given tables, with a SQL check where SQL can say it."""

from wicketlake.plans import boards, documents, ingest, labels, search, streams, text  # noqa: F401
from wicketlake.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
