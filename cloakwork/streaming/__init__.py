"""Masking on a stream."""
