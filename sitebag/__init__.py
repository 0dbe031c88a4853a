"""Spark operators for per-read modification calls, sample tables and their evaluation."""
