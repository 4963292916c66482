"""Training-data pipeline operators: language ID, archives, toxicity, near-duplicates, quality,
sharding, tokenisation, token files, decontamination and sketches."""
