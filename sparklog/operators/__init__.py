"""The layers (bronze, silver, gold, embeddings), retrieval and analytics."""
