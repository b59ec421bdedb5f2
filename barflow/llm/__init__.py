"""Operators of a training-data pipeline over text tables: scoring, filters, duplicates, archives, tokens, packing, shards."""
