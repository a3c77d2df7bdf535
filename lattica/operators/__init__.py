"""Kernels on matrices, block vectors and graphs, and the solvers built on them."""
