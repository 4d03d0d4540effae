"""Readers for game records, tables and documents, and adapters for other schemas."""
