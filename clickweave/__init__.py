"""Web-analytics operators for Spark: clickstream ingest, site and deployment
metrics, engagement, experiments and text jobs, in batch and as streams."""
