"""Encoder registry, feature pipelines, the benchmark and the checked queries."""
