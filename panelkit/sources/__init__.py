"""Tick stores on Hive-partitioned Parquet, CSV ingestion, and an interface for fetching archives."""
