"""Typed reads, ingestion, audits and a defect registry for raw Level-2 market data, as Spark jobs."""
