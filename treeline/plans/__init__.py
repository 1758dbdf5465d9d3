"""Compiled checks: of documents, and of tables."""
