"""Operators of a training-data pipeline: text extraction, filters, deduplication, packing, archives."""
