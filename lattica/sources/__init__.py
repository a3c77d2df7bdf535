"""Readers and writers of sparse-matrix, graph and task files."""
