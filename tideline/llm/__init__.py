"""Training-data preparation: sharding, decontamination, deduplication, extraction, filters, packing, token files."""
