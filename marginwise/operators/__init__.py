"""Relational building blocks: pair tables, ranks, matrices, metrics."""
