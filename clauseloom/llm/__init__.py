"""Training-data operators: dedup, joins, classifiers, mixing, tokens, packing, sharding."""
