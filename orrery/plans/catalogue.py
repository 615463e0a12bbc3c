"""The registered queries over the grid operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from orrery.plans import analytics, bodies, records, refinement, streams, topology

MODULES = (topology, analytics, refinement, bodies, records, streams)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
