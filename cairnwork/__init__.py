"""Spark-first retrieval, property-graph and corpus analytics operators."""
