"""Readers and writers of tables and interchange files."""
