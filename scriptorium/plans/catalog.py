"""The registered queries and their DuckDB counterparts."""

from scriptorium.plans import layout

QUERIES: dict = dict(layout.QUERIES)
ORACLES: dict[str, str] = dict(layout.ORACLES)
