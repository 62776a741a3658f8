"""All queries of the library outside the corpus operators, and their SQL."""

from __future__ import annotations

from contextloom.plans import documents, pages, queue, retrieval
from contextloom.plans.retrieval import answers  # noqa: F401  the flagship

PARTS = (documents, retrieval, pages, queue)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in PARTS for name, text in part.SQL.items()}
