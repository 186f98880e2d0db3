"""Plans made of operators: base embeddings, refinement, evaluation, the multi-level run."""
