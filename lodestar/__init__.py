"""Expertise matching and table maintenance as Spark DataFrame jobs."""
