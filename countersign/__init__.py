"""Bulk evidence processing for email sign-offs and approval workflows on Spark.

Subpackages
-----------
functions   Column -> Column building blocks (headers, addresses, hashes, trust, text)
operators   DataFrame -> DataFrame operators (decide, ledger, match, sweep, ...)
sources     readers and sinks
plans       whole jobs composed of operators (ingest a batch, replay a history)
streaming   the same jobs over Structured Streaming
workload    deterministic projections of the shared test tables
"""
from countersign.session import checkpointed, configure, local_session

__all__ = ["checkpointed", "configure", "local_session"]
