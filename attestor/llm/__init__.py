"""Training-data operators: filtering, deduplication, mixing and output of document corpora."""
