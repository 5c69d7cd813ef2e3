"""Scholarly-graph analytics and corpus preparation expressed as Spark jobs."""
