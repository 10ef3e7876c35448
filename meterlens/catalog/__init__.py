"""Every operator applied to the generated tables, by name."""

from . import audit, quota, review, rollups, streams, usage

QUERIES = {**usage.QUERIES, **audit.QUERIES, **review.QUERIES, **quota.QUERIES, **streams.QUERIES, **rollups.QUERIES}
