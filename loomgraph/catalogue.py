"""All queries of the engine and their oracle SQL, by name."""

from __future__ import annotations

from loomgraph import queries as _q
from loomgraph.queries import impact, keeping, lookup, stores, texts, views  # noqa: F401  register

QUERIES, ORACLES = _q.QUERIES, _q.ORACLES
