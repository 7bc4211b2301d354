"""Every registered query of the library's own operators, with its SQL."""

from skyloom.plans import arrays, imaging, logs, resampled, stores

_PARTS = (imaging, arrays, logs, resampled, stores)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
