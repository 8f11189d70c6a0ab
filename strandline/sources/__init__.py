"""Readers: parquet tables, JSON lines, flow records, saved state."""
