"""All queries of the core and the SQL that checks them."""

from braidwork.plans import accounting, answers, evaluation, graphs, ontologies, retrieval, roundtrips, shredded, stores, streams  # noqa: F401
from braidwork.plans.registry import QUERIES, SQL  # noqa: F401
