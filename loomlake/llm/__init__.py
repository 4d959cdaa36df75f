"""Training-data operators: joins, fingerprints, sharding, dedup, scoring, tokens, packing, chat."""
