"""Spark-first analytics for molecular-structure collections."""
