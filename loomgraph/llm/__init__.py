"""Training-data operators: extraction, packing, fingerprints, joins, models, filters and sharding for text corpora."""
