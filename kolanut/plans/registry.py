"""All queries and SQL twins, by name."""

from kolanut.plans import extraction, joining, mining, packing, rendering, scoring, seeding, validation

_PARTS = (extraction, validation, joining, rendering, scoring, mining, seeding, packing)

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
