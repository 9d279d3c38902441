"""All registered queries and their SQL."""

from __future__ import annotations

from . import documents, fits, live, palettes, pixels, spatial

MODULES = (fits, pixels, palettes, documents, spatial, live)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
