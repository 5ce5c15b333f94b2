"""Training-data operators: packing, counting, deduplication, filtering and scoring of whole corpora."""
