"""All registered queries of the library's own operators, and their SQL counterparts."""

from __future__ import annotations

from weftline.plans import curation, dialogue, sessions, storage

_PARTS = (dialogue, curation, sessions, storage)

QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
