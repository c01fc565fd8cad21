"""DataFrame operators of the ingestion analytics."""
