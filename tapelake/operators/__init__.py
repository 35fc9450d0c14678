"""Table jobs: typed scan, gaps, row groups, audits, registry rules, ingestion."""
