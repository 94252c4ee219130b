"""Training-data operators: decontamination, dedup, tokens, fingerprints, sharding, scoring."""
