"""Operators of a training-data pipeline (quality, near duplicates, PII, mixing, packing, ...)."""
