"""All registered queries of this package."""

from dossierlake.llm import queries  # noqa: F401  (registers the queries)
from dossierlake.llm.registry import ORACLES, QUERIES  # noqa: F401
