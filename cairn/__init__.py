"""Cairn: document ingestion, retrieval and corpus analytics as PySpark DataFrame operators."""
