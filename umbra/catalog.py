"""Every query of the library by name, and its SQL equivalent where there is one."""

from __future__ import annotations

from .plans import columns, connections, dialogue, governance, ingestion, media, privacy, replies, retrieval

_PARTS = (privacy, governance, connections, columns, retrieval, ingestion, dialogue, replies, media)

QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
