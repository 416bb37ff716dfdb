"""Readers and writers for documents and rule-pair files."""
