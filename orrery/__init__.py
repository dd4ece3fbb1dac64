"""Exact semantic retrieval, incremental indexing and corpus preparation on PySpark."""
