"""Import every query and oracle module so the registries are complete."""

from storelens.plans import (  # noqa: F401
    oracles_docs,
    oracles_extensions,
    oracles_functions,
    oracles_operations,
    oracles_records,
    oracles_reports,
    oracles_sources,
    oracles_state,
    oracles_streaming,
    queries_docs,
    queries_extensions,
    queries_functions,
    queries_operations,
    queries_records,
    queries_reports,
    queries_sources,
    queries_state,
    queries_streaming,
)
from storelens.plans.oracles import ORACLES  # noqa: F401
from storelens.plans.queries import QUERIES  # noqa: F401
