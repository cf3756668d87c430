"""All queries of the library by name, and their SQL."""

from .plans import base
from .plans import changes, evidence, facts, lists, metrics, notices, pages, scores, similar, streams, submissions, texts  # noqa: F401  (each registers its queries)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
