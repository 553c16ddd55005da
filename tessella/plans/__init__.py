"""The registered queries, their SQL, and the decision loop."""

from tessella.plans import agent, evidence, files, geometry, history, retrieval, scalars
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "agent", "evidence", "files", "geometry", "history", "retrieval", "scalars"]
