"""Operators for preparing training text: decontamination, token files,
nearest neighbours, packing, quality, line and suffix dedup, SimHash,
language identification, sharding. Nothing else in the package imports this."""
