"""Expressions, statistics, kernels and well-known binary."""
