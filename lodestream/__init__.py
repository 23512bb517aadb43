"""Knowledge-corpus engine on PySpark: ingestion, chunking, retrieval and incremental state."""
