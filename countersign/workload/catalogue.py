"""All registered queries."""
from countersign.workload import engine_queries, job_queries, ledger_queries, scalar_queries, stream_queries  # noqa: F401
from countersign.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
