"""Readers and writers: Parquet tables, request bodies, binary log segments."""
