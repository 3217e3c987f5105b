"""doclake: document ingestion, quality, analytics and reporting as Spark DataFrame jobs."""

__version__ = "0.1.0"
