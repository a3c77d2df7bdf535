"""Incremental graph statistics over streams of edges."""
