"""Operators for training-data corpora: packing, language and quality models, duplicates, mixing and sharding."""
