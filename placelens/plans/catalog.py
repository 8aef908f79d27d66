"""All registered queries of the observation engine."""

from __future__ import annotations

from placelens.plans import aggregates, graphs, joins, models, projections, retrieval, storage, streams, windows  # noqa: F401
from placelens.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
