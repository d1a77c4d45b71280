"""Posting extraction, matching and new/seen reporting as Spark DataFrame jobs."""
