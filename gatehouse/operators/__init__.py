"""DataFrame operators: index and search, store, ingestion, retrieval, simulation."""
