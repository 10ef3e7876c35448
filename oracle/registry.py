"""All oracles by query name."""

from . import audit, quota, review, rollups, streams, usage

PARTS = [usage.ORACLE, audit.ORACLE, review.ORACLE, quota.ORACLE, streams.ORACLE, rollups.ORACLE]

# The registered queries move doubles off rounding ties before they round to six digits; so do the oracles.
ORACLE = {name: sql.replace(", 6)", " + 1.23456789e-10, 6)") for part in PARTS for name, sql in part.items()}
