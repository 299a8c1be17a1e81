"""Incremental ingestion of judgement results."""
