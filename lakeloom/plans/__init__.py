"""Plans: ingest runs, staging and mart models, monitoring, query catalog."""
