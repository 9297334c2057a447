"""Operators: commit protocol, dedup, quality checks, governance, audit."""
