"""Enrichment analysis over entity-by-item tables, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
