"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import documents, joins, tables, totals, trees
from .streams import BOOK as STREAMS

_BOOKS = (trees.BOOK, joins.BOOK, totals.BOOK, tables.BOOK, documents.BOOK, STREAMS)
QUERIES = {k: f for b in _BOOKS for k, f in b.queries.items()}
ORACLE = {k: s for b in _BOOKS for k, s in b.sql.items()}
