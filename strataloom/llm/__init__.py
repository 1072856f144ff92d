"""Training-data operators: filtering, deduplication, archives, tokenisation and sharding on Spark."""
