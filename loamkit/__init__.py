"""loamkit: knowledge curation and retrieval as PySpark jobs."""
