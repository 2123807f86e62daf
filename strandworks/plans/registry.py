"""Every registered query and its SQL twin."""

from __future__ import annotations

from strandworks.plans import coding, corpus, evaluation, reports, tokens

_PARTS = (corpus, tokens, coding, reports, evaluation)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
