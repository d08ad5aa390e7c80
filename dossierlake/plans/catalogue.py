"""All registered queries."""

from dossierlake.plans import (  # noqa: F401  (registers the queries)
    q_audit,
    q_compare,
    q_measures,
    q_pages,
    q_records,
    q_resolve,
    q_scoring,
    q_sites,
    q_text,
)
from dossierlake.plans.registry import ORACLES, QUERIES  # noqa: F401
