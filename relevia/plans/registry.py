"""Registered queries of the core operators and their SQL counterparts."""

from relevia.plans import comparison, corpus, evaluation, pools, search, structure, texts

PARTS = (evaluation, search, corpus, pools, comparison, texts, structure)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
