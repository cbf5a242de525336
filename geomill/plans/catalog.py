"""All registered queries and the SQL that states the same results."""

from __future__ import annotations

from geomill.plans import clouds, meshes, more, streams, surfaces, vectors, volumes

_PARTS = (volumes, clouds, meshes, more, vectors, streams, surfaces)
QUERIES = {k: f for p in _PARTS for k, f in p.query.queries.items()}
ORACLE_SQL = {k: s for p in _PARTS for k, s in p.query.sql.items()}
FLAGSHIP = volumes.centre_of_gravity
