"""All registered queries but those of the training-data subpackage."""

from seqsieve.plans import gate_queries, signal_queries

QUERIES = {**signal_queries.QUERIES, **gate_queries.QUERIES}
ORACLES = {**signal_queries.ORACLES, **gate_queries.ORACLES}
