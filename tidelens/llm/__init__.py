"""Operators for training-data pipelines: scoring, deduplication, decontamination, packing, archives and mixing."""
