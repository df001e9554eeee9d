"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from wardloom.plans import event_queries, gate_queries, problems, text_queries

FLAGSHIP = "p5_sessions"
QUERIES = {**problems.QUERIES, **text_queries.QUERIES, **event_queries.QUERIES, **gate_queries.QUERIES}
SQL = {**problems.SQL, **text_queries.SQL, **event_queries.SQL, **gate_queries.SQL}
