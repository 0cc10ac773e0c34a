"""Queries over the driver's tables, each with the SQL that another engine runs for the same rows."""

from skein.catalog import analytics, correlation, detection, evidence, operations, services, text

QUERIES = analytics.QUERIES | text.QUERIES | correlation.QUERIES | detection.QUERIES | operations.QUERIES | evidence.QUERIES | services.QUERIES
ORACLES = analytics.ORACLES | text.ORACLES | correlation.ORACLES | detection.ORACLES | operations.ORACLES | evidence.ORACLES | services.ORACLES
