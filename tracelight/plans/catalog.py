"""All registered queries."""

from tracelight.plans import (  # noqa: F401
    catalog_evidence,
    catalog_ledger,
    catalog_lineage,
    catalog_similarity,
    catalog_sources,
    catalog_streaming,
    catalog_text,
    catalog_text_path,
)
from tracelight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
