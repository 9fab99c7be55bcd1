"""Queries: pipelines of operators over the driver tables."""
