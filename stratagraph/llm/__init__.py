"""Training-data operators: scoring, deduplication, search, sharding and tokenisation of documents."""
