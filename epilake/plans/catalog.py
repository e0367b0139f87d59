"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from epilake.plans import q_cases, q_geo, q_incidence, q_outbreaks, q_quality  # noqa: F401
from epilake.plans import q_io, q_streams, q_warehouse  # noqa: F401
from epilake.plans.registry import REGISTRY

FLAGSHIP = "expected_malaria"


def all_queries():
    return {k: q.build for k, q in REGISTRY.items()}


def all_oracles():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
