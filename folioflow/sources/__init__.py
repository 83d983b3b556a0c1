"""Scans: parquet tables, JSON/TXT/feed imports and an HTTP data source."""
