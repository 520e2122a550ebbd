"""DataFrame operators for corpus preparation, retrieval tables and usage analytics on Spark."""
