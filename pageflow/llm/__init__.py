"""Training-data operators: quality, near duplicates, decontamination, PII, packing, chat, archives, shards."""
