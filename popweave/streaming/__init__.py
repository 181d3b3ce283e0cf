"""Incremental result tables: resume and idempotent streaming appends."""
