"""Operators for large-scale training-data pipelines (see README, section llm)."""
