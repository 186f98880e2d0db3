"""Readers and writers of graphs, labels and embeddings."""
